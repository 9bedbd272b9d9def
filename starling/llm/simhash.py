"""SimHash near-dedup: pigeonhole blocks, Hamming verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._common import map_batches, materialise, outlive, signed, steps, table, unused
from .components import connected_components

BITS = 64
#: Shingles whose bits are summed at once, which bounds the memory for a very long text.
CHUNK = 1 << 16
#: Distinct fingerprints of one block that one task compares; larger blocks take the other exact way.
BLOCK_LIMIT = 2048
#: Keyed rows that are compared at once.
WORTHWHILE = 1 << 15
#: Runs up to this length are compared by shifted arrays, longer ones one by one.
SHORT_RUN = 24


def words_of(text: str | None) -> list[bytes]:
    """A-Z in lower case, words [^\\x20\\x09-\\x0D]+."""
    return text.encode().lower().split() if text else []


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of a text's words."""
    return fingerprint(words_of(text), shingle, seed)


def fingerprint(words: list[bytes], shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit fingerprint of shingles of `shingle` words with repeats, joined by one space.

    A bit is set if over half the shingles' XXH64 have it. Fewer words than a shingle: the whole sequence is the one
    shingle. No words: zero.
    """
    if not words:
        return 0
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    n = max(1, len(words) - shingle + 1)
    ends = starts[min(shingle, len(words)) :][:n] - 1
    digest = xxhash.xxh64_intdigest

    def hashes() -> Iterator[np.ndarray]:
        for at in range(0, n, CHUNK):
            spans = zip(starts[at : at + CHUNK][: n - at].tolist(), ends[at : at + CHUNK].tolist())
            yield np.array([digest(joined[a:b], seed) for a, b in spans], dtype="<u8")

    return of_hashes(hashes(), n)


def of_hashes(chunks: Iterator[np.ndarray], n: int) -> int:
    """Fingerprint of n shingles' 64-bit hashes: the bits that over half of them have."""
    sums = np.zeros(BITS, dtype=np.int64)
    for hashes in chunks:
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] | None = None, shingle: int = 4, seed: int = 42, name: str = "fp") -> DataFrame:
    """docs(doc_id, text, ...) -> the columns in `keep` (doc_id) and the fingerprint, a long called `name`; one row per row of docs."""
    keep = keep or ["doc_id"]
    rows = docs.select(*keep, F.col("text").alias(unused(keep, "text")))
    schema = rows.select(*keep, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((simhash(t.as_py(), shingle, seed) for t in batch.column(len(keep))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(made.view(np.int64))], names=[*keep, name])

    return map_batches(rows, run, schema)


def block_masks(max_distance: int, blocks: int) -> list[int]:
    """One mask for each choice of the blocks that a close pair may agree in.

    With `blocks` blocks, a pair that differs in at most max_distance bits agrees in at least
    blocks - max_distance of them, so some mask covers only bits in which it agrees.
    """
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(block, blocks - max_distance)]


def blocks_for(count: int, max_distance: int) -> int:
    """The fewest blocks, two matched ones at least, whose keys keep chance meetings to about eight a block."""
    blocks = max_distance + 2
    while blocks < max_distance + 6 and count / 2 ** ((blocks - max_distance) * BITS / blocks) > 8:
        blocks += 1
    return blocks


def _within(fps: np.ndarray, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each component of one block's fingerprints to its least member."""
    n, todo = len(fps), np.ones(len(fps), dtype=bool)
    us, vs = [], []
    for root in range(n):
        if not todo[root]:
            continue
        todo[root] = False
        frontier = [root]
        while len(frontier):
            rest = np.flatnonzero(todo)
            if not len(rest):
                break
            near = np.zeros(len(rest), dtype=bool)
            for i in frontier:
                near |= np.bitwise_count(fps[rest] ^ fps[i]) <= max_distance
            frontier = rest[near]
            todo[frontier] = False
            us.append(np.full(len(frontier), fps[root]))
            vs.append(fps[frontier])
    empty = np.empty(0, dtype=fps.dtype)
    return np.concatenate([empty, *us]), np.concatenate([empty, *vs])


def _block_links(max_distance: int):
    def whole_runs(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
        lengths = np.diff(np.append(first, len(fp)))
        left = np.repeat(first + lengths, lengths) - np.arange(len(fp)) - 1
        short = np.repeat(lengths <= SHORT_RUN, lengths)
        us, vs = [], []
        for shift in range(1, SHORT_RUN):
            i = np.flatnonzero(short & (left >= shift))
            if not len(i):
                break
            i = i[np.bitwise_count(fp[i] ^ fp[i + shift]) <= max_distance]
            us.append(fp[i])
            vs.append(fp[i + shift])
        for at in np.flatnonzero(lengths > SHORT_RUN):
            u, v = _within(fp[first[at] : first[at] + lengths[at]], max_distance)
            us.append(u)
            vs.append(v)
        empty = np.empty(0, dtype=np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([empty, *x]).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.uint64)
        for batch in batches:
            k = np.stack([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
            key, fp = np.concatenate([key, k]), np.concatenate([fp, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(fp) < WORTHWHILE:
                continue
            last = int(np.flatnonzero((key == key[-1]).all(axis=1))[0])  # the last run may go on
            if last:
                yield whole_runs(key[:last], fp[:last])
                key, fp = key[last:], fp[last:]
        if len(fp):
            yield whole_runs(key, fp)

    return run


def _ball(mask: int, radius: int) -> list[int]:
    """All changes of at most `radius` bits outside mask."""
    free = [1 << i for i in range(BITS) if not mask >> i & 1]
    return [signed(sum(c)) for r in range(radius + 1) for c in combinations(free, r)]


def close_pairs(fps: DataFrame, max_distance: int = 4, blocks: int | None = None, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """Distinct fps(fp) -> links(u, v) whose components are those of all pairs within max_distance bits.

    Fingerprints are joined on pigeonhole blocks and verified by Hamming distance. A block of more than
    SHORT_RUN members gives each of its components as a star, not as all pairs. Blocks of more than
    block_limit members are never gathered: there, two members are close exactly if the balls of half the
    distance around them meet, so the members of each such point are linked to the least of them, which is
    linear in the members. Nothing is capped. max_distance must be even.
    """
    if max_distance % 2:
        raise ValueError("max_distance must be even")
    blocks = blocks or blocks_for(fps.count(), max_distance)
    masks = block_masks(max_distance, blocks)
    keyed = fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks])).alias("t", "key"), "fp")
    crowded = materialise(keyed.groupBy("t", "key").count().filter(F.col("count") > block_limit).select("t", "key"), "crowded")
    links = None
    if crowded.limit(1).count():
        hot = materialise(keyed.join(crowded, ["t", "key"], "left_semi"), "crowded-members")
        keyed = keyed.join(crowded, ["t", "key"], "left_anti")
        balls = [(t, change) for t, m in enumerate(masks) for change in _ball(m, max_distance // 2)]
        balls = fps.sparkSession.createDataFrame(balls, "t int, change long")  # a constant of the settings: at most some 75,000 rows for 4 bits
        points = hot.join(F.broadcast(balls), "t").select("t", "fp", F.col("change").bitwiseXOR(F.col("fp")).alias("point"))
        met = points.groupBy("t", "point").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).filter("u < top").select("t", "point", "u")
        links = points.join(materialise(met, "crowded-points"), ["t", "point"]).filter("fp <> u").select("u", F.col("fp").alias("v")).distinct()
    runs = keyed.repartition("t", "key").sortWithinPartitions("t", "key", "fp").select("t", "key", "fp")
    found = map_batches(runs, _block_links(max_distance), "u long, v long")
    return found if links is None else found.union(links)


def near_duplicates(docs: DataFrame, max_distance: int = 4, shingle: int = 4, seed: int = 42, blocks: int | None = None, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fp, root, component_id), one row per row of docs.

    Rows with equal fingerprints, and fingerprints within max_distance bits, are linked; root is the least
    fingerprint (signed) reachable and component_id the smallest doc_id reachable, the row's own included.
    Null and empty texts have fingerprint zero and are linked like any other. A null doc_id is kept and never
    is a component_id; a component without any doc_id has a null component_id. Repeated rows stay repeated; an empty
    table gives an empty table. Only doc_id and text are read.
    """
    with steps():
        own = outlive(fingerprints(docs, ["doc_id"], shingle, seed), "fingerprints")
        n = own.count()
        classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes", n)
        roots = connected_components(close_pairs(classes.select("fp"), max_distance, blocks, block_limit))
        linked = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        linked = materialise(linked, "linked", n)
        ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
        ids = outlive(linked.select("fp", "root").join(ids, "root"), "components", n)
    return own.join(ids, "fp").select("doc_id", "fp", "root", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_row_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, text, ...), one for each row of chosen(doc_id, h) with that doc_id and xxhash64(text) = h; equal rows count once.

    Equal rows are dropped before they are shuffled, so one row that repeats is no hot key; texts are shuffled once.
    """
    h, own = unused(docs.columns, "h"), unused(docs.columns, "own")
    named = F.concat(F.when(F.col("doc_id").isNull(), "").otherwise("="), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))  # never null, so that both steps share one partitioning
    single = docs.withColumns({own: named, h: F.xxhash64("text")}).dropDuplicates([own, h])
    return single.join(chosen.select(named.alias(own), F.col("h").alias(h)), [own, h], "left_semi").select(docs.columns)


def one_of_each(docs: DataFrame, max_distance: int = 4, shingle: int = 4, seed: int = 42, **settings) -> DataFrame:
    """Rows of docs(doc_id, text, ...), one for each component of near_duplicates(): that with the smallest doc_id, then fingerprint.

    If several rows have both, one of them stays. A component whose rows all lack a doc_id keeps one of them. All columns
    stay as they are; an empty table gives an empty table.
    """
    with steps():
        h = F.xxhash64("text").alias("h")
        roots = near_duplicates(docs, max_distance, shingle, seed, **settings).select("fp", "root").distinct()
        rows = fingerprints(docs.select("doc_id", "text", h), ["doc_id", "h"], shingle, seed).join(roots, "fp")
        best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp", "h")).alias("best"))
        chosen = outlive(best.select("best.doc_id", "best.h"), "chosen")
    return one_row_each(docs, chosen)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")
