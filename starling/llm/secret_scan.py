"""Secret scans: key patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import map_batches, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are greedy, so dropping short runs and asking for long ones is the same
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
SEGMENT = re.compile(r"[^/=_-]+")
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class Entropy:
    """Settings of the entropy scan.

    A candidate is a run of 20 or more of [A-Za-z0-9+/_=-]. What the allow-list knows is cut out of it: places that match a
    pattern of `allow_places`, and segments between / = _ - in which a pattern of `allow` is found. The class of each stretch
    that is left is hex (only hex digits, with a letter), mixed (a digit and a letter) or letters (no digit, and more than one
    change from lower to upper case). Windows of `window` characters whose Shannon entropy reaches the class's threshold make
    spans.
    """

    window: int = 20
    thresholds: dict[str, float] = field(default_factory=lambda: {"hex": 2.9, "mixed": 3.6, "letters": 3.9})
    allow: tuple[str, ...] = (r"(?i)example|sample|dummy|placeholder|changeme|x{6,}", r"(?i)abcdefgh|01234567|12345678")
    allow_places: tuple[str, ...] = (r"(?<![0-9A-Za-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9A-Za-z])",)


def character_class(text: str) -> str | None:
    """The entropy class of a candidate, or None for plain numbers and words."""
    digits = any(c.isdigit() for c in text)
    if digits and re.fullmatch(r"[0-9a-fA-F]+", text):
        return "hex" if re.search("[a-fA-F]", text) else None
    if digits:
        return "mixed" if re.search("[A-Za-z]", text) else None
    return "letters" if len(re.findall("[a-z][A-Z]", text)) > 1 else None


def high_windows(text: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy in bits a character is threshold or more.

    Counts change by the one character that leaves and the one that enters, and so does the
    sum of c * log2(c) from which the entropy follows.
    """
    if len(text) < window:
        return []
    weigh = [c * log2(c) if c else 0.0 for c in range(window + 2)]
    counts: dict[str, int] = {}
    total, spans, base = 0.0, [], log2(window)
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += weigh[n + 1] - weigh[n]
        if i >= window:
            gone = text[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += weigh[n - 1] - weigh[n]
        if i >= window - 1 and base - total / window >= threshold - 1e-9:
            start = i - window + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, by start and then kind; ends are exclusive code points."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def stretches(text: str, start: int, end: int, settings: Entropy) -> Iterator[tuple[int, int]]:
    """The parts of a candidate that the allow-list leaves."""
    cut = [m.span() for p in settings.allow_places for m in re.compile(p).finditer(text, start, end)]
    cut += [m.span() for m in SEGMENT.finditer(text, start, end) if any(re.search(p, m[0]) for p in settings.allow)]
    at = start
    for a, b in sorted(cut):
        if a > at:
            yield at, a
        at = max(at, b)
    if at < end:
        yield at, end


def entropy_spans(text: str, settings: Entropy, known: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of high entropy that no known span covers; known is by start, as the spans are."""
    found, at, reach = [], 0, -1  # reach: the furthest end of the known spans that start no later
    for m in CANDIDATE.finditer(text):
        for start, end in stretches(text, *m.span(), settings):
            kind = character_class(text[start:end]) if end - start >= settings.window else None
            if kind is None:
                continue
            for a, b in high_windows(text[start:end], settings.window, settings.thresholds[kind]):
                a, b = a + start, b + start
                while at < len(known) and known[at][1] <= a:
                    at, reach = at + 1, max(reach, known[at][2])
                if b > reach:
                    found.append(("entropy", a, b))
    return found


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, settings: Entropy | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans), a row for each row.

    spans holds kind:start:end of the patterns and of the entropy scan, by start and then kind. A null or
    empty text has none. Whole texts are read, in time linear in them; other columns are not read. Repeated rows have equal
    results, an empty table none, and a doc_id may be null.
    """
    settings = settings or Entropy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                more = entropy_spans(text, settings, base)
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                every = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))
                rows.append((*n, len(more), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    rows = docs.select("doc_id", "text")
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def blot(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with every span, overlapping ones together, replaced by mark."""
    out, at = [], 0
    reach = -1
    for _, a, b in spans:
        if a >= at and a > reach:
            out += [text[at:a], mark]
        at = reach = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, settings: Entropy | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with the spans of scan() replaced by mark, overlapping ones by one; n_chars, if there is one, follows the text.

    Rows and other columns stay as they are, repeated rows and null ids too; a null or empty text stays as it is. An empty table
    gives an empty table.
    """
    settings = settings or Entropy()
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, changed = [], False
            for t in batch.column(at):
                text = t.as_py()
                base = base_spans(text or "")
                spans = sorted(base + entropy_spans(text or "", settings, base), key=lambda s: s[1])
                changed |= bool(spans)
                texts.append(blot(text, spans, mark) if spans else text)
            if not changed:
                yield batch
                continue
            columns = list(batch.columns)
            if count is not None:
                old = columns[count].to_pylist()
                columns[count] = pa.array([len(new) if new is not None and new != was else n for new, was, n in zip(texts, columns[at].to_pylist(), old)], columns[count].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(docs, run, docs.schema)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return scan(table(spark, sf_dir, "documents"))
