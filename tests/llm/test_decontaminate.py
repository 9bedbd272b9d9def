import hashlib
import random
import re

from starling.llm import decontaminate as D


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def slow(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                own = windows.get(tuple(w[s : s + n]))
                if own:
                    hit |= set(range(s, s + n))
                    found |= {i for i in own if i is not None}
        listed = sorted(map(str, found))
        near = {i for i, t in items if i is not None and is_near(w, words(t))}
        out.append((doc, len(w), len(hit), len(listed), hashlib.sha256(",".join(listed).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w), len(near)))
    return sorted(out, key=str)


def is_near(w, own):
    """Whether some window of the item has 90 % of its distinct words among as many words in a row of w."""
    n = min(len(own), 13)
    for s in range(max(1, len(own) - 12) if own else 0):
        terms = set(own[s : s + n])
        need = -(-9 * len(terms) // 10)
        if any(len(terms & set(w[p : p + n])) >= need for p in range(max(1, len(w) - n + 1))):
            return True
    return False


def corpus():
    rng = random.Random(7)
    w = lambda n, v=30: " ".join(rng.choice(["Aa", "b", "ÉC", "d1", "e"]) + str(rng.randint(0, v)) for _ in range(n))
    items = [(i, w(rng.choice([1, 2, 5, 12, 13, 14, 20, 40]), rng.choice([0, 3, 30]))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "!?"), (None, w(15)), (3, items[3][1]), (4, w(20)), (53, "same " * 20), (54, "ab")]
    docs = [(i, w(rng.randint(0, 60), rng.choice([0, 3, 30]))) for i in range(80)]
    for k in range(60):
        text = (rng.choice(items)[1] or "").split()
        docs.append((100 + k, f"{w(rng.randint(0, 30))}, {'! '.join(text[rng.randint(0, 3):])} {w(rng.randint(0, 400))}"))
    docs += [(200, None), (201, ""), (202, "..."), (None, items[5][1]), (None, "other text"), (203, "same " * 5000), (204, items[6][1] * 2), (204, items[6][1] * 2), (204, "different " + w(30)), (205, "AB"), (206, "x ab ")]
    return docs, items


def frames(spark):
    docs, items = corpus()
    return docs, items, spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, h int, w string"), spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, text2 string")


def test_equals_brute_force(spark):
    docs, items, d, b = frames(spark)
    got = sorted(map(tuple, D.contamination(d, b).drop("h").collect()), key=str)
    assert got == slow(docs, items)
    kept = D.keep_clean(d, b)
    assert kept.columns == d.columns
    bad = {str(r[0]) for r in got if r[5]} - {"204", "None"}
    assert not bad & {str(r.doc_id) for r in kept.collect()} and "204" in {str(r.doc_id) for r in kept.collect()}


def test_shuffled_joins_equal_broadcast_ones(spark, monkeypatch):
    docs, items, d, b = frames(spark)
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, D.contamination(d, b).drop("h").collect()), key=str) == slow(docs, items)


def test_empty_tables(spark):
    docs, items, d, b = frames(spark)
    assert D.contamination(d.limit(0), b).count() == 0
    assert all(not r.contaminated and r.n_hit == 0 for r in D.contamination(d, b.limit(0)).collect())


def near_corpus():
    """Items of which documents have all words but one, in another order, apart, or next to the ends."""
    rng = random.Random(17)
    w = lambda n: [f"{rng.choice('abc')}{rng.randint(0, 60)}" for _ in range(n)]
    items = [(i, " ".join(w(rng.choice([2, 3, 9, 10, 12, 13, 14, 25])))) for i in range(30)]
    docs = []
    for k in range(200):
        own = rng.choice(items)[1].split()
        kind = k % 6
        if kind in (1, 2, 5):
            own[rng.randrange(len(own))] = f"new{k}"
        if kind in (2, 3):
            rng.shuffle(own)
        if kind == 4:
            own = [x for word in own for x in (word, *w(rng.choice([0, 0, 1])))]
        docs.append((k, ["", "! "][k % 2] + " ".join(w(rng.choice([0, 3, 20])) + own + w(rng.choice([0, 3, 20]))) + ["", " ."][k % 3 == 0]))
    return docs, items


def test_proximity_equals_brute_force(spark, monkeypatch):
    docs, items = near_corpus()
    want = slow(docs, items)
    assert sum(r[6] > r[3] for r in want) > 25 and sum(r[6] == 0 for r in want) > 25
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, D.contamination(d, b).drop("h").collect()), key=str) == want
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(D, "BROADCAST_HASHES", 0)
    assert sorted(map(tuple, D.contamination(d, b).drop("h").collect()), key=str) == want


def test_a_missing_rarest_word_is_no_loss(spark):
    item = " ".join(f"w{i}" for i in range(13))
    docs = [(1, item.replace("w4", "zz")), (2, " ".join(reversed(item.split()))), (3, "w0 w1 w2 nothing else"), (4, item.replace("w4", "zz").replace("w5", "yy"))]
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {r.doc_id: (r.n_hit, r.n_near) for r in got.collect()} == {1: (0, 1), 2: (0, 1), 3: (0, 0), 4: (0, 0)}


def test_one_index_serves_several_benchmarks(spark):
    docs, items, d, b = frames(spark)
    whole = D.index(d).filter("term is not null").cache()
    assert whole.count() == sum(len(words(t)) for _, t in docs)
    for part in (b.filter("item_id < 20"), b.filter("item_id >= 20")):
        own = D.test_items(part)
        wins = D.windows(own, D.term_counts(d, own))
        hits, _ = D.matches(d, whole, own, wins)
        want = {r[0] for r in slow(docs, [tuple(r)[:2] for r in part.collect()]) if r[2]}
        assert {r.doc_id for r in hits.select("doc_id").distinct().collect()} == want


def test_a_common_one_word_item_brings_no_neighbours(spark):
    docs = spark.createDataFrame([(i, "the " * 50 + f"x{i}") for i in range(20)], "doc_id long, text string")
    got = D.contamination(docs, spark.createDataFrame([(1, "the")], "item_id long, text string")).collect()
    assert all(r.n_hit == 50 and r.n_near == 1 and r.contaminated for r in got)


def test_query(spark, tmp_path):
    docs, items, d, b = frames(spark)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    b.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, D.op9_decontamination(spark, str(tmp_path)).collect()), key=str) == slow(docs, items)
