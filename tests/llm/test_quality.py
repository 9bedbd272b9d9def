import random
from collections import Counter

import numpy as np

from starling.llm import quality as Q


def slow(text):
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


def test_statistics():
    rng = random.Random(4)
    texts = [None, "", " \n", "a", "a b c", "a b c a b c", "x\r\nx\r\nx\n", "é\xa0é\x85 # é", "a a a a", "w " * 100000]
    texts += ["".join(rng.choices(["a ", "b ", "\n", "é ", "# ", "\t"], k=rng.randint(0, 80))) for _ in range(500)]
    for t in texts:
        assert Q.statistics(t) == slow(t)


def test_forest_finds_the_odd_ones():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (1000, 3)), rng.normal(9, 1, (20, 3))])
    scores = Q.IsolationForest(x, 100, 256, 7).score(x)
    assert scores[1000:].min() > np.quantile(scores[:1000], 0.98)
    assert (Q.IsolationForest(x, 100, 256, 7).score(x) == scores).all()
    assert Q.IsolationForest(x[:0], 10, 256, 7).score(x).max() == 0
    assert Q.IsolationForest(np.ones((5, 3)), 10, 256, 7).score(x[:3]).shape == (3,)


def test_path_lengths_equal_a_walk_of_each_tree():
    """score() against every tree walked node by node for every point."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 2))
    forest = Q.IsolationForest(x, 20, 64, 3)
    h = lambda n: sum(1 / i for i in range(1, n + 1))
    for p, got in zip(x[:60], forest.score(x[:60])):
        total = 0.0
        for feature, split, child, length in forest.trees:
            at, depth = 0, 0
            while feature[at] >= 0:
                at, depth = child[at, int(p[feature[at]] > split[at])], depth + 1
            assert length[at] >= depth and depth <= forest.height
            total += length[at]
        assert np.isclose(got, 2 ** (-total / 20 / forest._expected(64)))
    assert abs(forest._expected(64) - (2 * h(63) - 2 * 63 / 64)) < 0.02


def test_leaves_count_their_points():
    """Every point of a tree's sample reaches the leaf whose length is its depth and what its number of points adds."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (50, 1))
    feature, split, child, length = Q.IsolationForest(x, 1, 50, 3).trees[0]
    reached = {}
    for p in x:
        at, depth = 0, 0
        while feature[at] >= 0:
            at, depth = child[at, int(p[feature[at]] > split[at])], depth + 1
        reached.setdefault(at, [depth, 0])[1] += 1
    assert sum(n for _, n in reached.values()) == 50
    assert all(np.isclose(length[at], depth + Q.IsolationForest._expected(n)) for at, (depth, n) in reached.items())


def slow_thresholds(rows, settings):
    """Each threshold by trying every step, on (good, scores) rows."""
    found, left = [2.0] * 4, list(rows)
    bad, good = sum(not g for g, _ in rows), sum(g for g, _ in rows)
    step = lambda s: int(np.floor(s * Q.BINS))
    while any(g for g, _ in left) and any(not g for g, _ in left):
        best = (0.0, None, [])
        for j in range(4):
            for t in range(Q.BINS + 2):
                b = sum(not g and step(s[j]) >= t for g, s in left)
                lost = sum(g and step(s[j]) >= t for g, s in left)
                gone = good - sum(g for g, _ in left)
                gain = b / bad - lost / good if lost + gone <= settings.max_good_loss * good and b >= settings.least_recall * bad else 0.0
                if gain > best[0] + 1e-12:
                    best = (gain, j, [t])
                elif gain > 0 and j == best[1] and abs(gain - best[0]) < 1e-12:
                    best[2].append(t)
        if best[1] is None or found[best[1]] < 2:
            return found
        found[best[1]] = (best[2][0] + best[2][-1] + 1) // 2 / Q.BINS
        left = [(g, s) for g, s in left if step(s[best[1]]) < found[best[1]] * Q.BINS]
    return found


def test_calibration_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(Q, "BINS", 50)
    for seed, loss in ((1, 0.0), (2, 0.05), (3, 0.2)):
        rng = np.random.default_rng(seed)
        rows = [(bool(g), [float(v) for v in np.clip(rng.normal(np.full(4, 0.5) + (0 if g else shift), 0.08), 0, 1)]) for g in rng.random(300) < 0.8 for shift in [np.array([0.0, 0.1, 0.25, 0.15])]]
        settings = Q.Settings(max_good_loss=loss)
        frame = spark.createDataFrame([(int(g), False, s) for g, s in rows] + [(0, True, [0.9] * 4)], "quality int, base_failed boolean, scores array<double>")
        got = Q.calibrate(frame, settings)
        assert got == slow_thresholds(rows, settings)
        assert min(got) < 2 and Q.rejects(np.array([s for g, s in rows if g]), got).mean() <= loss + 1e-9


def corpus(spark):
    rng = random.Random(9)
    good = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(60, 120))) for _ in range(150)]
    bad = [" ".join(f"{w}###" for w in t.split()) for t in good[:25]]
    rows = [(i, t, "kept", i) for i, t in enumerate(good + bad)] + [(900, None, "x", 0), (901, "", "x", 0), (None, good[0], "x", 0), (5, good[5], "x", 0)]
    labels = [(i, int(i < 150), 0) for i in range(0, 175, 2)] + [(2, 1, 1), (None, 0, 0), (3, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_judge_and_keep(spark, monkeypatch, tmp_path):
    docs, labels = corpus(spark)
    got = Q.judge(docs, labels).collect()
    assert len(got) == docs.count()
    verdicts = {r.doc_id: r for r in got}
    assert not any(verdicts[i].kept for i in range(150, 175)) and all(verdicts[i].kept for i in range(150))
    assert verdicts[900].base_failed and verdicts[901].base_failed and not verdicts[900].kept
    for limit in (Q.BROADCAST_ROWS, 0):
        monkeypatch.setattr(Q, "BROADCAST_ROWS", limit)
        kept = Q.keep_good(docs, labels).collect()
        assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in got if r.kept)
    assert kept[0].asDict().keys() == {"doc_id", "text", "kept", "score"}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    query = Q.op4_quality(spark, str(tmp_path))
    assert sorted((str(r.doc_id), r.kept) for r in query.collect()) == sorted((str(r.doc_id), r.kept) for r in got)


def test_without_labels_or_documents(spark):
    docs, labels = corpus(spark)
    assert all(r.kept == (not r.base_failed) for r in Q.judge(docs, labels.limit(0)).collect())
    assert Q.judge(docs.limit(0), labels).count() == 0
