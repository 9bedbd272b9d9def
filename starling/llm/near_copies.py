"""Near copies by Jaccard similarity of word shingles.

SimHash blocks find the close ones first; a prefix filter finds the rest, as 64 bits tell a similarity of 0.8 only roughly. Long
texts are dealt into parts, one of which near copies share as near copies; pairs whose parities of shingles differ too much there are left
out, which no near copies' do. Every link is verified on the shingles themselves,
and components are those of all such links."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._common import map_batches, materialise, outlive, signed, steps, unused
from .components import connected_components
from .simhash import CHUNK, close_pairs, of_hashes, one_row_each, words_of

#: Two texts are near copies if their sets of SHINGLE words in a row share LEAST[0] / LEAST[1] of their union or more.
SHINGLE = 5
LEAST = (4, 5)
#: Texts whose shingles are counted to tell the common ones, and how many of these are sent to every task. Both set the
#: order of the prefix filter and so its speed; any order finds the same pairs.
ORDER_ROWS = 20_000
MOST_COMMON = 200_000
COMMON = 8
#: Buckets at least that keys are dealt into, and texts whose prefixes a bucket holds; a task sorts one bucket at a time.
BUCKETS, TEXTS_IN_BUCKET = 256, 1_000
#: Rows of a bucket that leave Python together.
ROWS_OUT = 1 << 15
#: A text of 2 * PART shingles or more is dealt into a power of two of parts by its shingles' hashes, of PART to 2 * PART each on average.
PART = 256
#: Longs of the parities of a part's shingles, which bound how many of them two texts do not share.
PARITIES = 16
#: Rounds at most in which texts that no link joins yet meet one text each, while half of them are joined by it; more rounds only
#: leave fewer pairs to the exact join.
ROUNDS = 4
#: Texts to verify up to which their hashes, 8 bytes each, are broadcast, so that other texts are not shuffled; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: A text that is looked at counts as so many rows where rows are dealt into files.
TEXTS = 8
#: Texts that a task remembers to have seen, words whose hashes it remembers, and texts whose shingles it holds.
REMEMBERED, KNOWN_WORDS, HELD = 200_000, 50_000, 4


def node_of(words: list[bytes]) -> int:
    """Texts of one sequence of words are one node."""
    return signed(xxhash.xxh3_64_intdigest(b" ".join(words)))


def fingerprint(words: list[bytes]) -> int:
    """SimHash of the shingles, repeats included, as Spark's long; zero without words."""
    hashes = shingle_hashes(words)
    return signed(of_hashes((hashes[at : at + CHUNK] for at in range(0, len(hashes), CHUNK)), len(hashes))) if len(hashes) else 0


class _WordHashes(dict):
    """64-bit hashes of the words met so far, as bytes, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_digest(word)
        return found


_hashes = _WordHashes()
MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingle_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the shingles in order, repeats included; fewer words than a shingle are the one shingle, none have none."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    own, size = np.frombuffer(b"".join(map(_hashes.__getitem__, words)), dtype="<u8"), min(SHINGLE, len(words))
    count = len(words) - size + 1
    h = own[:count] * MULTIPLIERS[0]
    for k in range(1, size):
        h += own[k : k + count] * MULTIPLIERS[k]
    h ^= h >> np.uint64(32)
    h *= MULTIPLIERS[1]
    h ^= h >> np.uint64(29)
    return h


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct hashes of the shingles, sorted."""
    return np.unique(shingle_hashes(words))


def parts_of(n: int) -> int:
    """The parts of a text of n shingles."""
    return 1 << max(0, (n // PART).bit_length() - 1)


def levels(n: int) -> list[int]:
    """The numbers of parts in which a text of n shingles may meet its near copies: its own, and its half where shorter ones have that."""
    (a, b), own = LEAST, parts_of(n)
    return [own, own // 2] if own > 1 and a * n < b * PART * own else [own]


def parities(hashes: np.ndarray, parts: int = 1) -> np.ndarray:
    """For each of 64 * PARITIES places of each part, whether an odd number of the distinct hashes falls on it, as bits of longs.

    Two sets differ in as many elements as their parities differ in bits, or more. Those of half as many parts are the first half
    of the longs XOR the second.
    """
    places = 64 * PARITIES * parts
    odd = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefixes(own: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, n, pos, level, part) of the first shingles of each part of a text, by weight, for each of its levels.

    Near copies x and y have a part in which they are near copies too, as what they do not share is the sum of what their parts do
    not share. There they share LEAST of x's n shingles or more, so some shingle among the first n - ceil(LEAST * n) + 1 of both.
    """
    a, b = LEAST
    found = []
    for level in levels(len(own)):
        part = (own // np.uint64(64 * PARITIES) & np.uint64(level - 1)).astype(np.int32)
        order = np.argsort(part.astype(np.int64) << 40 | weight, kind="stable")  # own is sorted
        part, n = part[order], np.bincount(part, minlength=level).astype(np.int32)
        pos = np.arange(len(own), dtype=np.int32) - (np.cumsum(n, dtype=np.int32) - n)[part]
        n = n[part]
        first = pos <= n + -a * n // b  # n - ceil(LEAST * n)
        key = own[order][first] + np.uint64((level - 1) * int(MULTIPLIERS[2]) % 2**64)  # each level has its own keys
        found.append((key.view(np.int64), n[first], pos[first], np.full(len(key), level, dtype=np.int32), part[first]))
    return found[0] if len(found) == 1 else tuple(map(np.concatenate, zip(*found)))


def shingle_set(words: list[bytes]) -> frozenset:
    """The distinct shingles themselves."""
    return frozenset(zip(*(words[k:] for k in range(SHINGLE)))) if len(words) >= SHINGLE else frozenset([tuple(words)] if words else [])


def close_sets(p: frozenset, q: frozenset) -> bool:
    """Whether two sets of shingles are similar enough."""
    a, b = LEAST
    if b * min(len(p), len(q)) < a * max(len(p), len(q)):
        return False
    shared = len(p & q)
    return b * shared >= a * (len(p) + len(q) - shared)


def _rows(docs: DataFrame, keep: list[str], schema: str, maker) -> DataFrame:
    """The columns in `keep`, and for each row of docs what a task's make = maker() gives for its words, a tuple of the further columns."""
    rows = docs.select(*keep, F.col("text").alias(unused(keep, "text")))
    full = StructType(rows.select(*keep).schema.fields + StructType.fromDDL(schema).fields)
    types = to_arrow_schema(StructType.fromDDL(schema)).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in batches:
            made = [make(words_of(t.as_py())) for t in batch.column(len(keep))]
            arrays = [pa.array([m[i] for m in made], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *arrays], names=full.names)

    return map_batches(rows, run, full)


def _dealt(docs: DataFrame, buckets: int, maker) -> DataFrame:
    """(bucket, rows): what a task's make = maker() gives for the words of each text, an array of longs whose rows begin with a key.

    Rows are dealt by their keys and leave as bytes, a batch's of a bucket together: as rows of Spark's, a text's hundreds of
    shingles take several times the memory and the disk of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = maker()
        for batch in batches:
            found = [x for t in batch.column(0) if len(x := make(words_of(t.as_py())))]
            if found:
                rows = np.concatenate(found)
                bucket = (rows[:, 0].astype(np.uint64) >> np.uint64(32)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                own, starts = np.unique(bucket[order], return_index=True)
                blobs = [x.tobytes() for x in np.split(rows[order], starts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

    return map_batches(docs.select("text"), run, "bucket long, rows binary")


def _by_bucket(dealt: DataFrame, width: int, schema: str, work) -> DataFrame:
    """The columns that work(rows) makes of all rows of each bucket of _dealt(), rows of so many longs."""
    full = to_arrow_schema(StructType.fromDDL(schema))

    def whole(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        columns = work(np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, width))
        made = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=full.names)
        yield from (made.slice(k, ROWS_OUT) for k in range(0, len(made), ROWS_OUT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for bucket, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                if held and bucket != at:
                    yield from whole(held)
                    held = []
                at = bucket
                held.append(rows.as_py())
        if held:
            yield from whole(held)

    return map_batches(dealt.repartition("bucket").sortWithinPartitions("bucket"), run, schema)


def _common(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are common among some ORDER_ROWS rows of docs, sorted, and their counts."""
    every, least = max(1, n // ORDER_ROWS), COMMON
    some = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)

    def often(rows: np.ndarray):
        s, count = np.unique(rows, return_counts=True)
        return s[count >= least], count[count >= least]

    counted = _by_bucket(_dealt(some, BUCKETS, lambda: lambda w: shingles(w).view(np.int64)[:, None]), 1, "s long, count long", often)
    found = counted.orderBy(F.desc("count"), "s").limit(MOST_COMMON).toArrow()  # at most MOST_COMMON
    s, c = found.column("s").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(s)
    return s[order], c[order]


def packed(n: np.ndarray, pos: np.ndarray, level: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The places of prefixes() as a long each, as they are shuffled; a part has some 2 * PART shingles, far fewer than 2**16."""
    n, pos, level, part = (x.astype(np.int64) for x in (n, pos, level, part))
    return n | pos << 16 | np.log2(level).astype(np.int64) << 32 | part << 37


def unpacked(at: np.ndarray) -> tuple[np.ndarray, ...]:
    """The (n, pos, level, part) that packed() made `at` of."""
    return tuple(x.astype(np.int32) for x in (at & 0xFFFF, at >> 16 & 0xFFFF, 1 << (at >> 32 & 0x1F), at >> 37))


def shared_members(rows: np.ndarray) -> tuple:
    """Of rows (s, node, packed place), the columns of _shared(): each s that several nodes have, with each of its nodes once."""
    s, node, at = rows[np.lexsort((rows[:, 1], rows[:, 0]))].T
    other = np.append(True, s[1:] != s[:-1])
    once = other | np.append(True, node[1:] != node[:-1])
    s, node, at, starts = s[once], node[once], at[once], np.flatnonzero(other[once])
    count = np.diff(np.append(starts, len(s)))
    first, several = np.repeat(starts, count), np.repeat(count > 1, count)
    first, (n, pos, level, part) = first[several], unpacked(at)
    least = pa.StructArray.from_arrays([pa.array(x[first]) for x in (node, n, pos)], ["node", "n", "pos"])
    return *(x[several] for x in (s, node, n, pos, level, part)), least


def _shared(docs: DataFrame, n: int) -> DataFrame:
    """(s, node, n, pos, level, part, least): prefixes() of each node, in an order that all share, the rare shingles first.

    Only shingles s of several nodes are left; `least` has the node, n and pos of the smallest of these.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs, n))

    def maker():
        seen: set[int] = set()  # so that a text that repeats is no hot key

        def make(words: list[bytes]):
            node = node_of(words)
            if node in seen or not words:
                return ()
            if len(seen) >= REMEMBERED:
                seen.clear()
            seen.add(node)
            (known, counts), own = sent.value, shingles(words)
            at = np.searchsorted(known, own)
            at[at == len(known)] = 0
            weight = np.where(known[at] == own, counts[at], 0) if len(known) else np.zeros(len(own), dtype=np.int64)
            key, *places = prefixes(own, weight)
            return np.stack([key, np.full(len(key), node), packed(*places)], axis=1)

        return make

    dealt = _dealt(docs, max(BUCKETS, n // TEXTS_IN_BUCKET), maker)
    return _by_bucket(dealt, 3, "s long, node long, n int, pos int, level int, part int, least struct<node: long, n: int, pos: int>", shared_members)


def _may_be_close(n: Column, pos: Column, m: Column, at: Column) -> Column:
    """What sizes and the places of the first shared shingle allow."""
    a, b = LEAST
    shared = 1 + F.least(n - 1 - pos, m - 1 - at)
    return (b * F.least(n, m) >= a * F.greatest(n, m)) & ((a + b) * shared >= a * (n + m))


def _apart_bits(one: str, other: str) -> Column:
    """Bits in which the parities of two parts differ."""
    return sum((F.bit_count(F.col(one)[k].bitwiseXOR(F.col(other)[k])) for k in range(PARITIES)), F.lit(0))


def _xor(one: Column, other: Column) -> Column:
    return F.zip_with(one, other, lambda x, y: x.bitwiseXOR(y))


def _all_apart_bits(one: str, other: str) -> Column:
    """Bits in which the parities of two texts differ, all parts together; null where one has over twice the other's parts, and so over twice its shingles."""
    x, y = F.col(one), F.col(other)
    half = lambda c: _xor(F.slice(c, F.lit(1), (F.size(c) / 2).cast("int")), F.slice(c, ((F.size(c) / 2).cast("int")).cast("int") + 1, (F.size(c) / 2).cast("int")))
    bits = lambda c, d: F.aggregate(_xor(c, d), F.lit(0), lambda s, z: s + F.bit_count(z))
    return F.when(F.size(x) == F.size(y), bits(x, y)).when(F.size(x) == 2 * F.size(y), bits(half(x), y)).when(2 * F.size(x) == F.size(y), bits(x, half(y)))


def _part_parities(odd: Column, level: Column, part: Column) -> Column:
    """The parities of a part, of those of a text's own parts or of half as many."""
    of = lambda k: F.slice(odd, PARITIES * k + 1, F.lit(PARITIES))
    return F.when(F.size(odd) == PARITIES * level, of(part)).otherwise(_xor(of(part), of(part + level)))


def _may_share(n: Column, m: Column, apart: Column) -> Column:
    """What the differing bits of the parities allow: near copies of n and m shingles differ in (n + m) * (b - a) / (a + b) at most."""
    a, b = LEAST
    return (a + b) * apart <= (b - a) * (n + m)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rows: int | None = None) -> DataFrame:
    """Those of pairs(u, v), at most so many rows, whose shingles are similar enough; classes(node, h) has the hash of a text of each node."""
    pairs = materialise(pairs.distinct(), "pairs", rows)
    n = pairs.count()
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = materialise(classes.select("node", "h").join(wanted, "node", "left_semi"), "wanted")
    texts, keys = docs.select(F.xxhash64("text").alias("h"), F.col("text").alias("t")), wanted.select("h")
    texts = texts.join(F.broadcast(keys) if wanted.count() <= BROADCAST_ROWS else keys, "h", "left_semi")
    texts = materialise(texts.dropDuplicates(["h"]).join(wanted, "h").select("node", "t"), "pair-texts", 2 * n * TEXTS)
    side = lambda x: texts.select(F.col("node").alias(x), F.col("t").alias(f"text_{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "text_u", "text_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = lru_cache(HELD)(lambda t: shingle_set(words_of(t)))
        for batch in batches:
            close = [close_sets(sets(x), sets(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(close, pa.bool_()))

    return materialise(map_batches(both, run, "u long, v long"), "close-pairs", n * TEXTS)


def by_simhash(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """links(u, v) of nodes that are near copies and whose fingerprints differ in a few bits: enough to join most copies, not all."""
    firsts = materialise(classes.groupBy("fp").agg(F.min("node").alias("first")), "firsts", n)
    equal = classes.join(firsts, "fp").filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    one = lambda x: firsts.select(F.col("fp").alias(x), F.col("first").alias(f"n{x}"))
    close = close_pairs(firsts.select("fp")).join(one("u"), "u").join(one("v"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    return _verified(equal.union(close), docs, classes)


def _alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of pairs(u, v) that the parities of classes(node, n, odd) allow, those of all parts: (u, v, n_u, n_v, apart)."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("apart", _all_apart_bits("odd_u", "odd_v"))
    return both.filter(_may_share(F.col("n_u"), F.col("n_v"), F.col("apart"))).select("u", "v", "n_u", "n_v", "apart")


def _parts_alike(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of rows(u, v, level, part, n_u, n_v), parts of two texts, that the parts' parities allow: (u, v, apart), bits a shingle."""
    for x in ("u", "v"):
        side = classes.select(F.col("node").alias(x), F.col("odd").alias("odd"))
        rows = rows.join(side, x).withColumn(f"odd_{x}", _part_parities(F.col("odd"), F.col("level"), F.col("part"))).drop("odd")
    rows = rows.withColumn("apart", _apart_bits("odd_u", "odd_v")).filter(_may_share(F.col("n_u"), F.col("n_v"), F.col("apart")))
    return rows.select("u", "v", (F.col("apart") / (F.col("n_u") + F.col("n_v"))).alias("apart"))


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs with whether known(node, root) has both ends in one component."""
    side = lambda x: known.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    both = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left")
    return both.withColumn("joined", F.coalesce(F.col("root_u") == F.col("root_v"), F.lit(False))).drop("root_u", "root_v")


def _leaders(rows: DataFrame, classes: DataFrame, turn: int) -> DataFrame:
    """One pair(u, v) for each node that shares a shingle with the shingle's leader of this turn, of another component: the likeliest."""
    first = F.min_by(F.struct("node", "n", "pos", "root"), F.xxhash64("node", "s", F.lit(turn)))
    led = rows.join(rows.groupBy("s").agg(first.alias("lead")), "s").filter("root <> lead.root")
    led = led.filter(_may_be_close(F.col("n"), F.col("pos"), F.col("lead.n"), F.col("lead.pos")))
    led = led.select(F.col("node").alias("u"), F.col("lead.node").alias("v"), "level", "part", F.col("n").alias("n_u"), F.col("lead.n").alias("n_v")).distinct()
    best = _parts_alike(led, classes).groupBy("u").agg(F.min_by("v", F.struct("apart", "v")).alias("v"))
    return _alike(best, classes).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _components(links: DataFrame) -> DataFrame:
    """connected_components() of links that are written and so are quickly counted."""
    return connected_components(links, links.count())


def _open(members: DataFrame) -> DataFrame:
    """The s of members(s, root) that have several roots."""
    return members.groupBy("s").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least <> most").select("s")


def by_prefix(docs: DataFrame, classes: DataFrame, n: int, found: DataFrame) -> DataFrame:
    """links(u, v) of nodes which, with found(u, v), have the components of all near copies.

    The members of a shingle are held against its least one, then those of shingles that still have several components against
    other members, one each in a round. Only what is left is held against all members of other components. A group of near copies
    so costs its size; no pair is left out but those whose ends are joined already or whose sizes, places or parities rule it out.
    """
    known = _components(found)
    rows = materialise(_shared(docs, n), "shared-shingles")
    count = rows.count()
    others = rows.filter(F.col("node") != F.col("least.node"))
    star = others.filter(_may_be_close(F.col("n"), F.col("pos"), F.col("least.n"), F.col("least.pos")))
    star = star.select(F.col("least.node").alias("u"), F.col("node").alias("v"), "level", "part", F.col("least.n").alias("n_u"), F.col("n").alias("n_v")).distinct()
    star = materialise(_apart(star, known).filter("not joined").drop("joined"), "stars", count)
    star = materialise(_parts_alike(star, classes).select("u", "v").distinct(), "alike-stars", star.count())
    links = _verified(_alike(star, classes).select("u", "v"), docs, classes, star.count())
    roots = _components(found.union(links))
    root_of = lambda node, name: roots.select(F.col("node").alias(node), F.col("root").alias(name))
    others = others.withColumn("first", F.col("least.node")).join(root_of("node", "root"), "node", "left").join(root_of("first", "first_root"), "first", "left")
    others = materialise(others.select("s", "node", "n", "pos", "level", "part", "first", F.coalesce("root", "node").alias("root")), "other-members")
    others = materialise(others.join(_open(others), "s", "left_semi").drop("root"), "open-members", count)
    count = others.count()
    for turn in range(ROUNDS):
        rows = others.join(root_of("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        tried = materialise(_leaders(rows, classes, turn), "leaders", n)
        most = tried.count()
        more = _verified(tried, docs, classes, most)
        links = links.union(more)
        roots = _components(found.union(links))
        if 2 * more.count() <= most:
            break
    members = others.join(root_of("node", "root"), "node", "left").join(root_of("first", "first_root"), "first", "left")
    members = members.withColumns({"root": F.coalesce("root", "node"), "first_root": F.coalesce("first_root", "first")}).drop("first")
    members = materialise(members.join(_open(members), "s", "left_semi"), "last-members", count)
    odds = classes.join(members.select("node").distinct(), "node", "left_semi").select("node", "odd")
    members = members.join(odds, "node").withColumn("odd", _part_parities(F.col("odd"), F.col("level"), F.col("part"))).drop("level", "part")
    rest = members.filter("root <> first_root")
    mates = members.select(F.col("s").alias("mate_s"), F.col("node").alias("mate"), F.col("n").alias("mate_n"), F.col("pos").alias("mate_pos"), F.col("root").alias("mate_root"), F.col("odd").alias("mate_odd"))
    once = (F.col("root") < F.col("mate_root")) | (F.col("mate_root") == F.col("first_root")) & (F.col("root") != F.col("mate_root"))
    close = _may_be_close(F.col("n"), F.col("pos"), F.col("mate_n"), F.col("mate_pos")) & _may_share(F.col("n"), F.col("mate_n"), _apart_bits("odd", "mate_odd"))
    pairs = rest.join(mates, (F.col("s") == F.col("mate_s")) & once & close)
    pairs = materialise(pairs.select(F.least("node", "mate").alias("u"), F.greatest("node", "mate").alias("v")).distinct(), "last-pairs")
    return links.union(_verified(_alike(pairs, classes).select("u", "v"), docs, classes, pairs.count()))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Rows of docs(doc_id, text, ...), one for each component of near copies: that with the smallest doc_id, one of them if it repeats.

    A component whose rows all lack a doc_id keeps one of them. All columns stay as they are. Texts without words, null among
    them, are copies of each other. Equal rows count once; an empty table gives an empty table.
    """
    with steps():
        rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
        own = _rows(rows, ["doc_id", "h"], "node long, fp long, n long, odd array<long>", lambda: lambda w: (node_of(w), fingerprint(w), len(s := shingles(w)), parities(s, parts_of(len(s)))))
        best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("best")
        classes = materialise(own.groupBy("node").agg(best, F.min("h").alias("h"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("odd").alias("odd")), "classes")
        n = classes.count()
        first = by_simhash(docs, classes, n)
        roots = _components(first.union(by_prefix(docs, classes, n, first)))
        linked = classes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
        chosen = outlive(linked.select("best.doc_id", "best.h"), "chosen", n)
    return one_row_each(docs, chosen)
