"""BPE encoding by per-prefix dynamic programming over vocabulary matches, and decoding."""

from __future__ import annotations

import hashlib
import json
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import map_batches, table

#: Fixed value: the split of the byte-level format before merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A character outside these ranges may have another class in another Unicode version; the library then splits the text.
UNSURE = r"[^\x00-\u052F\u0600-\u06FF\u0904-\u0939\u1E00-\u1F15\u2010-\u205E\u20A0-\u20BF\u2190-\u23FF\u2500-\u27BF\u3001-\u303F\u3041-\u3096\u3099-\u30FF\u4E00-\u9FEF\uAC00-\uD7A3\uFF01-\uFF5E\U0001F300-\U0001F64F]"
#: Characters of pieces that a worker remembers; what is beyond is worked out again.
REMEMBERED = 8_000_000
#: Longer texts are split in blocks of so many pieces, which bounds the memory.
LONG, BLOCK = 1 << 20, 1 << 16
NEVER = 1 << 60
LONG_PIECE = 1 << 12
BIG_ENDIAN = sys.byteorder == "big"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def byte_alphabet() -> dict[str, str]:
    """The format's stand-in for each byte -> the byte as a Latin-1 character.

    Visible bytes stand for themselves, the others are numbered from 256.
    """
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): chr(b) for b in seen} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary as read from the JSON of its file.

    A prefix of a piece has exactly one token that can end its encoding: a vocabulary match that ends there,
    such that the last token of what is before it and the match stay apart under the merges.
    """

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] for t in spec["added_tokens"])
        odd = any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix"))
        if odd or model["type"] != "BPE" or split.get("type") != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"] or model["ignore_merges"] or not plain:
            raise ValueError("not a plain byte-level BPE file")
        alphabet = byte_alphabet()
        latin = lambda t: "".join(alphabet[c] for c in t)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {latin(t): i for t, i in model["vocab"].items() if t not in self.special}
        if missing := [b for b in range(256) if chr(b) not in vocabulary]:
            raise ValueError(f"the vocabulary lacks {len(missing)} bytes, the first of them {missing[0]:#04x}, so not every text has tokens")
        self.size = 1 + max(*model["vocab"].values(), *self.special.values(), -1)
        self.bytes: list[bytes] = [b""] * self.size
        for t, i in vocabulary.items():
            self.bytes[i] = t.encode("latin-1")
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.rank: dict[int, int] = {}  # pair -> order of its merge
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = (latin(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            a, b, whole = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.rank.setdefault(a * self.size + b, rank)
            parts.setdefault(whole, (a, b, rank))
        self.right, self.left = ([self._edge(i, side, parts) for i in range(self.size)] for side in (1, 0))
        self.automaton = ahocorasick.Automaton()
        for t, i in vocabulary.items():
            if i not in parts or self._made(*parts[i]):
                self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.apart: dict[int, bool] = {}
        self.find, self.unsure = regex.compile(PIECES), regex.compile(UNSURE)
        self.stops = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known = _Known(self)

    @staticmethod
    def _edge(i: int, side: int, parts: dict[int, tuple[int, int, int]]) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of token i while it is built, each with the merge that ends it."""
        found = [(i, NEVER)]
        while i in parts:
            found.append((parts[i][side], parts[i][2]))
            i = parts[i][side]
        return found

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether, before the merge `before`, a merge joins something across the border of a and b.

        Of two equal merges the left one goes first, so a piece of a that the same merge takes is gone, a piece of b is not.
        """
        for x, end in self.right[a]:
            for y, last in self.left[b]:
                rank = self.rank.get(x * self.size + y)
                if rank is not None and rank < min(end, before) and rank <= last:
                    return True
        return False

    def _made(self, a: int, b: int, rank: int) -> bool:
        """Whether the merges of a token's bytes end in that token."""
        return not self._crossed(a, b, rank)

    def _stay_apart(self, a: int, b: int) -> bool:
        key = a * self.size + b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 300_000:
                self.apart.clear()
            known = self.apart[key] = not self._crossed(a, b, NEVER)
        return known

    def piece(self, text: str) -> list[int]:
        """Ids of one piece: the last token of every prefix, then back from the end."""
        raw = text.encode().decode("latin-1")
        if len(raw) <= LONG_PIECE:
            last, length = [-1] * (len(raw) + 1), [0] * (len(raw) + 1)
        else:  # arrays take eight bytes a place
            last, length = array("l", [-1]) * (len(raw) + 1), array("l", [0]) * (len(raw) + 1)
        size, apart = self.size, self.apart.get
        for end, (n, i) in self.automaton.iter(raw):  # longest match first at each end
            end += 1
            if last[end] < 0:
                if n == end:
                    last[end], length[end] = i, n
                elif (before := last[end - n]) >= 0:
                    fits = apart(before * size + i)
                    if fits or (fits is None and self._stay_apart(before, i)):
                        last[end], length[end] = i, n
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= length[at]
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if not self.stops:
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self._plain(p) for k, p in enumerate(self.stops.split(text)))

    def _plain(self, text: str) -> bytes:
        get, unsure = self.known.__getitem__, self.unsure.search(text)
        if len(text) <= LONG or unsure:
            found = b"".join(map(get, _library_pieces(text) if unsure else self.find.findall(text)))
            self.known.bound()
            return found
        out, pieces = [], self.find.finditer(text)
        while block := [m[0] for m in islice(pieces, BLOCK)]:
            out.append(b"".join(map(get, block)))
            self.known.bound()
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that ids stand for; what is no UTF-8 becomes U+FFFD."""
        get, numbers = self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4")
        raw = b"".join(b"".join(map(get, numbers[at : at + LONG].tolist())) for at in range(0, len(numbers), LONG))
        return raw.decode("utf-8", "replace").encode()


def _library_pieces(text: str) -> Iterator[str]:
    """Pieces of a text as the tokenizers library cuts them."""
    from tokenizers.pre_tokenizers import ByteLevel

    return (text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text))


class _Known(dict):
    """Encodings of the pieces met so far, forgotten when they take too much room."""

    def __init__(self, model: Bpe):
        super().__init__()
        self.model, self.held = model, 0

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self.model.piece(piece))
        if BIG_ENDIAN:
            ids.byteswap()
        ids = ids.tobytes()
        self.held += len(piece) + 8
        self[piece] = ids
        return ids

    def bound(self) -> None:
        if self.held > REMEMBERED:
            self.clear()
            self.held = 0


@lru_cache(maxsize=2)
def _loaded(blob: bytes) -> Bpe:
    return Bpe(blob)


def _blob(path: str | None) -> bytes:
    with open(path or tokenizer_path(), "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, ids array<int>), a row for each row; null and empty texts have no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(_blob(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared.value)
        for batch in batches:
            ids = [np.frombuffer(model.encode(t.as_py() or ""), dtype="<i4") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded(doc_id, ids, ...) -> (doc_id, text); null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(_blob(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared.value)
        for batch in batches:
            texts = [model.decode(np.array(ids.as_py() or [], dtype="<u4").tobytes()).decode() for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each row.

    Ids are digested as little-endian unsigned 32-bit integers, the decoded text as UTF-8. A null text counts as
    empty. Only doc_id and text are read; a text is held with its ids, and nothing else is. Repeated rows have equal results, an
    empty table none, and a doc_id may be null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_blob(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _loaded(shared.value)
        for batch in batches:
            counts, own, back = [], [], []
            for t in batch.column(1):
                ids = model.encode(t.as_py() or "")
                counts.append(len(ids) // 4)
                own.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(model.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(own, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select("doc_id", F.col("text")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    return digests(table(spark, sf_dir, "documents"))
