import random

import pytest
import xxhash

from starling.llm import simhash as S
from starling.llm._common import signed
from starling.llm.components import connected_components


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_roots(nodes, close):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if close(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


TEXTS = [None, "", "  \n", "One", "one", "a b c", "A b c d", "a b c d e f", "x\ty\nz\r w\x0bv\x0cu", "É é\xa0w a b c", "tie tie tie tie tie", "a b c d " * 30, "a b c d " * 30, "ß" * 500, "long " * 70000]


@pytest.mark.parametrize("text", TEXTS[:-1])
def test_fingerprint(text):
    assert S.simhash(text) == slow_fingerprint(text)


def test_long_text_is_summed_in_chunks():
    assert S.simhash(TEXTS[-1]) == S.simhash("long " * 10)


@pytest.mark.parametrize("blocks", [5, 6, 7, 8, 10])
def test_masks_catch_every_close_pair(blocks):
    masks, rng = S.block_masks(4, blocks), random.Random(blocks)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def clusters(rng):
    made = set()
    for size in (3, 40, 60):
        base = rng.getrandbits(64)
        made |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(size)}
    chain = rng.getrandbits(64)
    for _ in range(20):
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        made.add(chain)
    return sorted(signed(f) for f in made | {rng.getrandbits(64) for _ in range(100)})


@pytest.mark.parametrize("limit,blocks", [(2048, None), (8, 6), (30, 7)])
def test_links_keep_every_component(spark, limit, blocks):
    fps = clusters(random.Random(limit))
    links = S.close_pairs(spark.createDataFrame([(f,) for f in fps], "fp long"), block_limit=limit, blocks=blocks)
    assert all((r.u ^ r.v).bit_count() <= 4 if (r.u ^ r.v) >= 0 else ((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 4 for r in links.collect())
    got = {r.node: r.root for r in connected_components(links).collect()}
    want = slow_roots(fps, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {f: got.get(f, f) for f in fps} == want


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (900, 800), (900, 800)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(201)} | {800: 800, 900: 800}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


SCHEMA = "doc_id long, text string, fp string, root long, t int"


def test_near_duplicates_and_one_of_each(spark):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(3, "One", "x", 1, 2), (None, "one", "y", 0, 0), (None, "alone at last", "y", 0, 0), (None, "alone at last", "y", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = S.near_duplicates(docs.select("doc_id", "text", "fp", "root", "t")).collect()
    assert len(got) == len(rows)
    fps = {i: slow_fingerprint(t) if t != TEXTS[-1] else S.simhash(t) for i, t in enumerate(TEXTS)}
    want = slow_roots(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    for r in got:
        if r.doc_id is not None:
            assert (r.fp & (2**64 - 1), r.component_id) == (fps[r.doc_id], want[r.doc_id])
    kept = S.one_of_each(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(want.values()))
    assert [r.text for r in kept if r.doc_id is None] == ["alone at last"]
    assert kept[0].asDict().keys() == {"doc_id", "text", "fp", "root", "t"}
    assert S.one_of_each(docs.limit(0)).count() == 0


def test_a_doc_id_with_two_texts_loses_no_component(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    for rows in ([(100, b), (204, a), (204, b)], [(100, b), (204, b), (204, a)], [(204, b), (204, b), (204, a), (204, a)]):
        kept = [(r.doc_id, r.text) for r in S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
        assert sorted(kept) == [(min(i for i, t in rows if t == x), x) for x in sorted((a, b), key=lambda x: min(i for i, t in rows if t == x))], rows


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, fp int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op1_simhash(spark, str(tmp_path)).collect()}
    fps = {i: S.simhash(t) for i, t in enumerate(TEXTS)}
    want = slow_roots(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
