"""Language ID: one bit-sliced Bloom filter whose slots are language bitmasks, over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import map_batches, table

NOT_LETTERS = regex.compile(r"[^\p{L}]+")
LETTER = regex.compile(r"\p{L}")
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Code points of a text that are hashed at once; blocks overlap by the longest n-gram less one.
BLOCK = 1 << 18
BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


@dataclass(frozen=True)
class Settings:
    """The filter is fitted on some sample_docs labelled rows of each language, and holds all n-grams of these.

    The sample has the rows whose hash is below sample_docs / rows of the language: all of them if they are no more than
    sample_docs, else about that many, and one at least. Each language has places_per_gram slots for each n-gram of the one with most of them.
    """

    orders: tuple[int, ...] = (2, 3, 4)
    sample_docs: int = 1500
    places_per_gram: int = 24
    seed: int = 42


def grams(text: str, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Hashes of a text's n-grams, repeats included: letters in lower case, with one space for all else and at both ends."""
    points = np.frombuffer(f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    over = max(orders) - 1
    for at in range(0, max(len(points) - over, 1), BLOCK):
        block = points[at : at + BLOCK + over]
        final = at + BLOCK + over >= len(points)
        for n in orders:
            count = len(block) - n + 1 if final else BLOCK
            if count > 0:
                h = np.full(count, n, dtype=np.uint64)
                for k in range(n):
                    h = (h ^ block[k : k + count]) * np.uint64(MULTIPLIERS[0])
                    h ^= h >> np.uint64(29)
                yield h


class LanguageFilter:
    """slots[i] has the bit of language l set if an n-gram of l hashes to i; all of an n-gram's slots together tell its languages.

    A slot is a row of bytes, eight languages each, so any number of languages has its bits.
    """

    def __init__(self, languages: list[str], members: list[np.ndarray], settings: Settings):
        self.languages, self.settings = languages, settings
        most = max(map(len, members), default=0)
        self.bits = max(10, (most * settings.places_per_gram - 1).bit_length())
        self.slots = np.zeros((1 << self.bits, -(-len(languages) // 8)), dtype=np.uint8)
        for bit, hashes in enumerate(members):
            for places in self._places(hashes):
                self.slots[places, bit // 8] |= np.uint8(1 << bit % 8)
        self.false = self._popcounts(self.slots) / len(self.slots)
        self.false **= len(MULTIPLIERS)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        for m in MULTIPLIERS:
            yield (hashes * np.uint64(m)) >> np.uint64(64 - self.bits)

    def _popcounts(self, masks: np.ndarray) -> np.ndarray:
        """How many of the masks have each language's bit."""
        counts = [np.bincount(column, minlength=256) @ BIT_OF_BYTE for column in masks.T]
        return np.concatenate([np.zeros(0), *counts])[: len(self.languages)]

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """All languages that may contain each n-gram, as rows of bytes."""
        first, *rest = self._places(hashes)
        found = self.slots[first]
        for places in rest:
            found = found & self.slots[places]
        return found

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language whose share of the text's n-grams, less what false positives add, is greatest, and that share.

        Of equal shares the language with the most labelled rows wins. No letter, or no language: und and 0.
        """
        if not text or not LETTER.search(text) or not self.languages:
            return "und", 0.0
        hits, total = np.zeros(len(self.languages)), 0
        for hashes in grams(text, self.settings.orders):
            hits += self._popcounts(self.masks(hashes))
            total += len(hashes)
        share = (hits / max(total, 1) - self.false) / np.maximum(1 - self.false, 1e-9)
        best = int(np.argmax(share))
        return self.languages[best], float(np.clip(share[best], 0.0, 1.0))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, settings: Settings | None = None) -> LanguageFilter:
    """docs(doc_id, text, lang, ...) -> a filter for the languages of its rows; rows without doc_id, text or lang are left out.

    Rows of one doc_id, lang and text count once. The languages and the n-grams of the sample come to the driver: at most as
    many as sample_docs texts of each language have.
    """
    settings = settings or Settings()
    known = docs.filter("doc_id is not null and lang is not null and text is not null")
    parts = 1 << 30
    known = known.withColumn("hash", F.pmod(F.xxhash64("doc_id", "text", F.lit(settings.seed)), F.lit(parts)))
    rows = known.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n"), F.min("hash").alias("least")).orderBy(F.desc("n"), "lang").collect()  # one row a language
    languages = [r.lang for r in rows]
    if not rows:
        return LanguageFilter([], [], settings)
    shares = [(r.lang, max(r.least + 1, parts * settings.sample_docs // max(r.n, settings.sample_docs))) for r in rows]
    sample = known.join(F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, most long")), "lang").filter("hash < most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                by.setdefault(lang, []).extend(np.unique(g) for g in grams(text.as_py(), settings.orders))
            for lang, parts in by.items():
                if parts:
                    values = np.unique(np.concatenate(parts))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64))], names=["lang", "gram"])

    found = map_batches(sample.select("lang", "text"), run, "lang string, gram long").distinct().toPandas()
    members = [found.gram[found.lang == lang].to_numpy(dtype=np.int64).view(np.uint64) for lang in languages]
    return LanguageFilter(languages, members, settings)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, lang_pred, score), a row for each row.

    Whole texts are read, in blocks. A null text and one without a letter are und with score 0. A row without
    doc_id is not held out. Equal texts have equal results.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shared.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return map_batches(rows, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs.filter(~held_out())))
