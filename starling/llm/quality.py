"""Quality rules: rule statistics, an isolation forest over each, thresholds from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import map_batches, materialise, steps, table

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\v\f\r"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
#: What the forests see: the rule statistics, free of a text's length.
RATES = ["word_chars a word", "symbols a word", "duplicates a line", "repeats a word"]
#: Steps of the score between 0 and 1 in which labelled rows are counted.
BINS = 4000
#: Labelled ids up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Settings:
    """The forests are fitted on at most sample_rows labelled rows, those of least hash of doc_id.

    Thresholds come from all labelled rows that pass the base rules. Of the statistics, the one whose score tells most bad rows
    from good ones (greatest recall less loss) gets the first threshold, the middle of equals; then the next, on the rows that
    are left, while it finds at least least_recall of all bad rows. All thresholds together lose at most max_good_loss of the
    good rows.
    """

    sample_rows: int = 4096
    trees: int = 128
    subsample: int = 256
    seed: int = 42
    max_good_loss: float = 0.005
    least_recall: float = 0.01


def repeated_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    if len(seen) < 2_000_000:
        keys = (ids[:-2] * len(seen) + ids[1:-1]) * len(seen) + ids[2:]
    else:  # a cube would not fit: number the pairs first
        _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        keys = pairs[:-1].astype(np.int64) * len(seen) + ids[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    often = np.zeros(len(keys) + 2, dtype=bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    hit = often.copy()
    hit[1:] |= often[:-1]
    hit[2:] |= often[:-2]
    return int(hit.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """STATISTICS of a whole text; null has none.

    Words are [^\\x20\\x09-\\x0D]+; n_lines counts \\n-split lines with a word, n_dup_lines those equal to an earlier one.
    """
    if not text:
        return (0,) * 6
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    space = len(raw) - len(raw.translate(None, SPACE))
    return len(words), len(text) - space, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def base_failed(stats: np.ndarray) -> np.ndarray:
    return (stats[:, 0] < 50) | (100 * stats[:, 4] > 50 * stats[:, 0])


def rates(stats: np.ndarray) -> np.ndarray:
    """RATES of rows of STATISTICS."""
    n, lines = np.maximum(stats[:, 0], 1), np.maximum(stats[:, 5], 1)
    return np.stack([stats[:, 1] / n, stats[:, 2] / n, stats[:, 3] / lines, stats[:, 4] / n], axis=1)


class IsolationForest:
    """Random trees over a sample; a point that few random splits isolate scores near 1."""

    def __init__(self, sample: np.ndarray, trees: int, subsample: int, seed: int):
        rng = np.random.default_rng(seed)
        self.subsample = min(subsample, len(sample))
        self.height = max(1, int(np.ceil(np.log2(max(self.subsample, 2)))))
        self.trees = [self._tree(sample[rng.choice(len(sample), self.subsample, replace=False)], rng) for _ in range(trees if len(sample) else 0)]

    @staticmethod
    def _expected(n: int) -> float:
        """Mean path length of an unsuccessful search among n points."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n

    def _tree(self, points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []  # feature or -1, split, left, right, path length
        todo = [(points, 0, -1, 0)]
        while todo:
            rows, depth, parent, side = todo.pop()
            at = len(nodes)
            if parent >= 0:
                nodes[parent][2 + side] = at
            low, high = rows.min(axis=0), rows.max(axis=0)
            free = np.flatnonzero(high > low)
            if depth >= self.height or not len(free):
                nodes.append([-1, 0.0, at, at, depth + self._expected(len(rows))])
                continue
            f = int(rng.choice(free))
            split = rng.uniform(low[f], high[f])
            nodes.append([f, split, 0, 0, 0.0])
            left = rows[:, f] <= split
            todo += [(rows[left], depth + 1, at, 0), (rows[~left], depth + 1, at, 1)]
        a = np.array(nodes)
        return a[:, 0].astype(np.int64), a[:, 1], a[:, 2:4].astype(np.int64), a[:, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length), between 0 and 1; zeros without any tree."""
        if not self.trees or not len(x):
            return np.zeros(len(x))
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, child, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.height):
                at = child[at, (x[rows, feature[at]] > split[at]).astype(np.int64)]
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self._expected(self.subsample), 1e-9))


class Judge:
    """An isolation forest over each of RATES: how few random splits part a text's rate from those of the sample."""

    def __init__(self, stats: np.ndarray, settings: Settings):
        found = rates(stats)
        self.forests = [IsolationForest(found[:, [j]], settings.trees, settings.subsample, settings.seed + j) for j in range(len(RATES))]

    def scores(self, stats: np.ndarray) -> np.ndarray:
        found = rates(stats)
        return np.stack([f.score(found[:, [j]]) for j, f in enumerate(self.forests)], axis=1)


def measure(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id and STATISTICS, a row for each row; a null text has zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([statistics(t.as_py()) for t in batch.column(1)], dtype=np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in made.T.copy())], names=["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in STATISTICS))


def known_quality(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, ...) -> one row for each labelled doc_id; repeated ids take the least quality."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, ...) that have a label, with their quality; texts of the others are not shuffled."""
    known = known_quality(labels)
    return docs.join(F.broadcast(known) if labels.count() <= BROADCAST_ROWS else known, "doc_id")


def fit(rows: DataFrame, settings: Settings) -> Judge:
    """The judge of a bounded sample of labelled rows(doc_id, *STATISTICS)."""
    order = F.xxhash64(F.col("doc_id"), F.lit(settings.seed))
    sample = rows.select(*STATISTICS, order.alias("h")).orderBy("h", *STATISTICS).limit(settings.sample_rows).toPandas()
    return Judge(sample[STATISTICS].to_numpy(dtype=np.int64), settings)


def scored(stats: DataFrame, model: Judge) -> DataFrame:
    """stats with base_failed and the scores of the forests, in the order of RATES."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    places = [stats.columns.index(c) for c in STATISTICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy() for i in places], axis=1)
            made = pa.array(list(shared.value.scores(x)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base_failed(x)), made], names=[*batch.schema.names, "base_failed", "scores"])

    return map_batches(stats, run, stats.select("*", F.lit(True).alias("base_failed"), F.array(F.lit(0.0)).alias("scores")).schema)


def calibrate(rows: DataFrame, settings: Settings) -> list[float]:
    """The score from which each statistic rejects, over labelled rows(quality, base_failed, scores); 2, which none reaches, where it tells nothing."""
    rows = rows.filter("not base_failed").select((F.col("quality") > 0).alias("good"), F.transform("scores", lambda s: F.floor(s * BINS).cast("int")).alias("bins"))
    thresholds, totals = [2.0] * len(RATES), None
    while True:
        left = rows.filter(F.aggregate(F.zip_with("bins", F.array(*[F.lit(t * BINS) for t in thresholds]), lambda b, t: b < t), F.lit(True), lambda a, b: a & b))
        counts = left.select("good", F.posexplode("bins").alias("j", "bin")).groupBy("j", "good", "bin").count().collect()  # at most 2 * BINS rows a statistic
        found = np.zeros((len(RATES), 2, BINS + 2))
        for r in counts:
            found[r.j, int(r.good), r.bin] += r["count"]
        now = found[0].sum(axis=1)  # bad and good rows left
        totals = now if totals is None else totals
        if not now.all():
            return thresholds
        bad, good = np.moveaxis(np.cumsum(found[:, :, ::-1], axis=2)[:, :, ::-1], 1, 0)
        spare = settings.max_good_loss * totals[1] - (totals[1] - now[1])
        gain = np.where((good <= spare) & (bad >= settings.least_recall * totals[0]), bad / totals[0] - good / totals[1], 0.0)
        j = int(gain.max(axis=1).argmax())
        best = np.flatnonzero(gain[j] == gain[j].max())
        if gain[j].max() <= 0 or thresholds[j] < 2:
            return thresholds
        thresholds[j] = int(best[0] + best[-1] + 1) // 2 / BINS


def rejects(scores: np.ndarray, thresholds: list[float]) -> np.ndarray:
    """By the steps in which the thresholds were counted."""
    return (np.floor(scores * BINS) >= np.array(thresholds) * BINS).any(axis=1)


def train(rows: DataFrame, settings: Settings) -> tuple[Judge, list[float]]:
    """The judge and the thresholds of labelled rows(doc_id, *STATISTICS, quality)."""
    model = fit(rows, settings)
    return model, calibrate(scored(rows, model), settings)


def judge(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """docs(doc_id, text, ...) and labels(doc_id, quality, ...) -> doc_id, STATISTICS, base_failed, scores, kept.

    One row for each row of docs. A null or empty text has zeros and fails the base rules. Without labelled
    rows of both kinds the base rules alone decide. Equal texts have equal results, repeated rows too; a row without doc_id
    is judged and has no label, and an empty table gives an empty table.
    """
    settings = settings or Settings()
    stats = materialise(measure(docs), "statistics")
    model, thresholds = train(labelled(stats, labels), settings)
    below = F.aggregate(F.zip_with("scores", F.array(*[F.lit(t * BINS) for t in thresholds]), lambda s, t: F.floor(s * BINS) < t), F.lit(True), lambda a, b: a & b)
    return scored(stats, model).withColumn("kept", ~F.col("base_failed") & below)


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; null and empty texts go, repeated rows stay repeated.

    Only labelled texts are measured twice. Each row is judged where it is read, so texts are not shuffled.
    """
    settings = settings or Settings()
    with steps():
        known = labelled(docs.select("doc_id", "text"), labels).select("doc_id", "text")
        stats = materialise(measure(known), "statistics")
        model, thresholds = train(labelled(stats, labels), settings)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(at)], dtype=np.int64).reshape(-1, 6)
            yield batch.filter(pa.array(~base_failed(x) & ~rejects(shared.value.scores(x), thresholds)))

    return map_batches(docs, run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
