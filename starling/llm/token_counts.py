"""Token counts of a unigram vocabulary: Aho-Corasick matches and a Viterbi pass that keeps counts only."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from ._common import map_batches, table

#: Fixed values of the unigram format: the mark of a space, and how much worse than the worst piece an unknown character is.
SPACE = "\u2581"
UNKNOWN_PENALTY = 10.0
#: Characters of words that a worker remembers, and the length from which a text's words are taken in blocks.
REMEMBERED, LONG, BLOCK = 8_000_000, 1 << 20, 1 << 16


def vocabulary(path: str | None = None) -> tuple[list[str], list[float], bool]:
    """Pieces that text can match, their scores, and whether a byte stands for what is none, of a sentencepiece file; by default the public one.

    Control, unknown, unused and byte pieces match no text, so `</s>` in a text is four characters.
    """
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(len(model))
    own = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    return [model.id_to_piece(i) for i in own], [model.get_score(i) for i in own], sum(map(model.is_byte, ids)) == 256


class UnigramCounter:
    """The number of pieces in the best segmentation of each word, a word being a space mark and what follows.

    Ties go to the longer last piece: of equal scores the earlier start stays. A character that is no piece is unknown; a
    run of unknown characters becomes its UTF-8 bytes where the vocabulary has byte pieces, else one piece.
    """

    def __init__(self, pieces: list[str], scores: list[float], bytes_: bool = False):
        self.automaton = ahocorasick.Automaton()
        for piece, score in zip(pieces, scores):
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(scores) - UNKNOWN_PENALTY
        self.bytes = bytes_
        self.known: dict[str, int] = {}
        self.held = 0
        self.words = regex.compile(f"{SPACE}?[^{SPACE}]+|{SPACE}")

    def word(self, text: str) -> int:
        """Pieces of one word."""
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        lost = [False] * (n + 1)  # whether the last piece is an unknown character
        at, single = 0, False

        def close(end: int) -> None:
            """After all matches that end at `end`: the unknown character, if that character is no piece."""
            if single:
                return
            score = best[end - 1] + self.unknown
            if best[end] is None or score > best[end]:
                best[end], lost[end] = score, True
                count[end] = count[end - 1] + (len(text[end - 1].encode()) if self.bytes else 0 if lost[end - 1] else 1)

        for last, (length, score) in self.automaton.iter(text):
            end = last + 1
            while at < end:
                if at:
                    close(at)
                at, single = at + 1, False
            single |= length == 1
            total = best[end - length] + score
            if best[end] is None or total > best[end]:
                best[end], count[end], lost[end] = total, count[end - length] + 1, False
        while at <= n:
            if at:
                close(at)
            at, single = at + 1, False
        return count[n]

    def _remembered(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            found = self.known[word] = self.word(word)
            self.held += len(word) + 8
        return found

    def text(self, text: str | None) -> int:
        """Pieces of a whole text; spaces become marks, and a text that starts with none gets one."""
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        text = text if text.startswith(SPACE) else SPACE + text
        if len(text) <= LONG:
            return sum(map(self._remembered, self.words.findall(text)))
        total, words = 0, self.words.finditer(text)
        while block := [m[0] for m in islice(words, BLOCK)]:
            total += sum(map(self._remembered, block))
        return total


def token_counts(docs: DataFrame, pieces: list[str], scores: list[float], bytes_: bool = False) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_tokens), a row for each row; null and empty texts have none.

    Whole texts are counted; the vocabulary is sent to the workers once. Repeated rows have equal counts, an empty table has none,
    and a doc_id may be null; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((pieces, scores, bytes_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(*shared.value)
        for batch in batches:
            counts = [counter.text(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts(table(spark, sf_dir, "documents"), *vocabulary())
