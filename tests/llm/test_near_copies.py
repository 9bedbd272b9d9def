import random

import numpy as np

from starling.llm import near_copies as N


def slow(texts):
    """The smallest index of each text's component, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if (x == y or 5 * len(x & y) >= 4 * len(x | y)) and root[a] < root[b]:
                    root[b], changed = root[a], True
    return root


def texts():
    rng = random.Random(3)
    w = lambda n: [rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(n)]
    out, passage = [], w(30)
    for size in (60, 120, 300):
        base = w(size)
        for k in range(30):  # from nearly the same to less than 0.8
            t = list(base)
            for _ in range(k % 7):
                t[rng.randrange(size)] = rng.choice(["x", "y"]) + str(k)
            out.append(" ".join(t))
    out += [" ".join(passage + w(rng.randint(5, 60))) for _ in range(40)]
    return out + ["one two", "One  TWO", "one two three", "", None, " \t", "a b c d e f", "a b c d e g"]


def test_keeps_one_of_each_component_of_five_word_jaccard(spark, monkeypatch):
    monkeypatch.setattr(N, "COMMON", 4)
    rows = texts()
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(rows)] + [(None, "one two", "x"), (None, "quite alone", "x"), (None, "quite ALONE", "x")], "doc_id long, text string, node string")
    kept = N.one_of_each(docs).collect()
    root = slow(rows)
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(set(root)) and 3 < len(set(root)) < len(rows)
    assert [r.text.lower() for r in kept if r.doc_id is None] == ["quite alone"]
    assert N.one_of_each(docs.limit(0)).count() == 0


def test_parities_bound_what_two_sets_do_not_share():
    rng = np.random.default_rng(5)
    for size in (0, 1, 5, 400, 5000):
        x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: size // 2], rng.integers(0, 2**64, size // 3, dtype=np.uint64)]))
        differ = int(np.bitwise_count((N.parities(x) ^ N.parities(y)).view(np.uint64)).sum())
        assert N.parities(x).shape == (N.PARITIES,) and differ <= len(np.setxor1d(x, y))


def test_a_group_of_near_copies_costs_its_size(spark, monkeypatch):
    rng = random.Random(9)
    base, rows = [f"w{i}" for i in range(100)], []
    for k in range(200):  # two of them differ in 0.7 to 0.9 of their shingles
        t = list(base)
        for _ in range(2):
            t[rng.randrange(100)] = f"x{k}"
        rows.append(" ".join(t))
    compared, verified = [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *a: (compared.append(pairs.distinct().count()), verified(pairs, *a))[1])
    kept = N.one_of_each(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(slow(rows)))
    assert sum(compared) <= 8 * len(rows), compared


def test_near_copies_share_a_key_of_a_part_that_its_parities_allow():
    rng = np.random.default_rng(7)
    for n, m in [(300, 260), (511, 513), (520, 500), (639, 512), (640, 800), (1024, 1000), (1100, 1020), (1300, 1040), (5000, 4300), (4, 5)]:
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        shared = -(-4 * (n + m) // 9)  # just 0.8 of the union
        y = np.unique(np.concatenate([rng.permutation(x)[:shared], rng.integers(0, 2**64, m - shared, dtype=np.uint64)]))
        rows = []
        for own in (x, y):
            key, size, _, level, part = N.prefixes(own, (own % np.uint64(3)).astype(np.int64))
            rows.append({int(k): (int(s), int(l), int(p)) for k, s, l, p in zip(key, size, level, part)})

        def odd(own, level, part):
            return N.parities(own, level).reshape(level, -1)[part].view(np.uint64)

        def allowed(key):
            (s, level, part), (t, *other) = rows[0][key], rows[1][key]
            assert [level, part] == other
            return 9 * int(np.bitwise_count(odd(x, level, part) ^ odd(y, level, part)).sum()) <= s + t

        assert any(allowed(k) for k in rows[0].keys() & rows[1].keys()), (n, m)


def test_long_texts_that_share_less_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(N, "COMMON", 10**9)  # as for shingles that the counted texts lack
    rng = random.Random(11)
    base, rows = [f"w{i}" for i in range(2000)], []
    for k in range(60):
        t = list(base)
        for i in rng.sample(range(2000), 120):
            t[i] = f"x{k}"
        rows.append(" ".join(t))
    rows += [t.replace("w7 ", "z ", 1) for t in rows[:5]]
    compared, verified = [], N._verified
    monkeypatch.setattr(N, "_verified", lambda pairs, *a: (compared.append(pairs.distinct().count()), verified(pairs, *a))[1])
    kept = N.one_of_each(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(slow(rows))) and len(kept) == 60
    assert sum(compared) <= 2 * len(rows), compared


def test_shingles_are_shuffled_in_bulk(spark):
    rng = random.Random(13)
    rows = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(400)) for _ in range(300)]
    rows += [t.replace(" ", " z ", 1) for t in rows[:50]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    sc = spark.sparkContext
    sc.setJobGroup("bulk", "near copies")
    kept = N.one_of_each(docs).count()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, tracker, written = sc._jsc.sc().statusStore(), sc.statusTracker(), 0
    for job in tracker.getJobIdsForGroup("bulk"):
        for stage in tracker.getJobInfo(job).stageIds:
            written += store.lastStageAttempt(stage).shuffleWriteRecords()
    assert kept == 300
    assert 0 < written < 30_000, written  # the texts have 138,650 shingles


def test_steps_of_few_rows_are_few_files(spark, monkeypatch, tmp_path):
    from starling.llm import _common

    monkeypatch.setattr(_common, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(_common, "_delete", lambda paths: None)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "31"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        assert N.one_of_each(spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")).count() > 3
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = {}
    for part in tmp_path.glob("*/part-*"):
        name = part.parent.name.rsplit("-", 1)[0]
        files[name] = files.get(name, 0) + 1
    steps = len(list(tmp_path.iterdir()))
    assert sum(files.values()) <= 4 * steps, (steps, sum(files.values()), files)
