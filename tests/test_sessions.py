import pytest
from pyspark.sql import functions as F

from starling.operators import selection as L, sessions as S
from starling.streaming.session_state import live_sessions, session_windows, windowed_counts

EVENTS = "session_id long, seq long, event_type string, t string, item_id long"


@pytest.fixture
def events(spark):
    rows = [(s, i, ["view", "like", "reset", "dislike", "view"][(i * 7 + s) % 5], f"2024-01-01 00:{i:02d}:00", (i * 3 + s) % 9) for s in range(4) for i in range(40)]
    rows += [(9, 100, "view", "2024-01-01 00:00:00", None), (9, 101, "like", "2024-01-01 00:01:00", 5), (9, 102, "view", "2024-01-01 00:02:00", 5)]
    return spark.createDataFrame(rows, EVENTS).select("session_id", "seq", "event_type", F.to_timestamp("t").alias("ts"), "item_id")


def test_profile_takes_the_surest_opinion(events):
    got = [r for r in S.active_profile(S.since_reset(events)).collect() if r.session_id == 9]
    assert [(r.item_id, r.rating, r.confidence) for r in got] == [(5, 5.0, 1.0)]


def test_weights_fade(events):
    got = S.event_weights(S.recent(S.since_reset(events))).filter("session_id = 9").orderBy("age").collect()
    assert [round(r.long_weight, 6) for r in got] == [round(2.8 * 0.66, 6), round(7 * 0.985, 6), round(2.8 * 0.66 * 0.985**2, 6)]
    assert [round(r.explicit_weight, 6) for r in got] == [0, round(7 * 0.992, 6), 0]


def test_short_share(spark):
    cases = [(0.0, 5.0, 0.9), (5.0, 0.5, 0.0), (5.0, 5.0, 0.5), (8.0, 5.0, 0.1), (2.0, 5.0, 0.1)]
    got = [r[0] for r in spark.createDataFrame(cases, "s double, l double, a double").select(S.short_share(F.col("s"), F.col("l"), F.col("a"))).collect()]
    assert [round(g, 4) for g in got] == [0.0, 0.32, 0.34, 0.24, 0.12]


def test_stream_keeps_what_the_batch_keeps(spark, events, tmp_path):
    events.repartition(3).write.json(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema(events.schema).json(f"{tmp_path}/in")
    q = live_sessions(stream).writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.session_id, r.seq) for r in spark.table("kept").collect())
    assert got == sorted((r.session_id, r.seq) for r in S.since_reset(events).collect())


def test_windows(events):
    assert sum(r.n for r in windowed_counts(events).collect()) == events.count()
    assert sum(r.n for r in windowed_counts(events, slide="30 minutes").collect()) == 2 * events.count()
    assert {r.n for r in session_windows(events).collect()} == {40, 3}


def candidates(spark):
    rows = [(1, i, b, 100.0 - i, [f"g{i % 4}", "x"], [f"t{i % 3}"]) for i in range(60) for b in (["interest", "explore", "collaborative"][i % 3],)]
    return spark.createDataFrame(rows, "session_id long, item_id long, bucket string, value double, genres array<string>, tags array<string>")


def test_targets():
    assert L.targets(10, True) == {"interest": 6, "collaborative": 2, "explore": 2}
    assert L.targets(10, False) == {"interest": 8, "collaborative": 0, "explore": 2}
    assert L.targets(2, True) == {"interest": 2, "collaborative": 0, "explore": 0}


def test_blend_meets_its_quotas_and_interleaves(spark):
    liked = spark.createDataFrame([(1, "g1", 1)], "session_id long, genre string, rank int")
    chosen = L.blend(candidates(spark), liked, 10)
    rows = chosen.collect()
    assert len({r.item_id for r in rows}) == 10 and sum(r.bucket == "collaborative" for r in rows) >= 2
    order = [r.bucket[0] for r in L.interleave(chosen).orderBy("shown").collect()]
    assert order[:4] == ["i", "i", "c", "e"]


def test_diversify_and_mmr(spark):
    rows = [(1, i, ["same"], 10.0 - i) for i in range(4)] + [(1, 9, ["other"], 5.0)]
    got = L.diversify(spark.createDataFrame(rows, "session_id long, item_id long, genres array<string>, value double"), 3).orderBy("position").collect()
    assert [r.item_id for r in got] == [0, 9, 1]
    rows = [(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.9, [0.0, 1.0])]
    got = L.mmr(spark.createDataFrame(rows, "user_id long, item_id long, relevance double, vector array<double>"), 2).orderBy("position").collect()
    assert [r.item_id for r in got] == [1, 3]


def test_backfill(spark):
    chosen = spark.createDataFrame([(1, 5, 1), (2, 6, 1), (2, 7, 2)], "session_id long, item_id long, position int")
    scores = spark.createDataFrame([(5, 9.0), (6, 8.0), (7, 7.0), (8, 6.0)], "item_id long, score double")
    got = {}
    for r in L.backfill(chosen, scores, 3).orderBy("session_id", "position").collect():
        got.setdefault(r.session_id, []).append(r.item_id)
    assert got == {1: [5, 6, 7], 2: [6, 7, 5]}


def test_reasons(spark):
    from starling.operators.recommend import reasons

    rows = spark.createDataFrame([("interest", ["Drama"], 3), ("collaborative", ["War"], 4), ("explore", [], None)], "bucket string, genres array<string>, support long")
    assert [r.reason for r in reasons(rows).collect()] == ["Close to the Drama you like", "Liked by 4 people with your taste", "Something new"]


def test_candidates_of_everyone_are_those_of_all_cosines(spark, monkeypatch):
    from starling.operators import sessions, vectors
    from starling.plans import catalog

    data = "/root/testdata/sf0.001"
    profiles, events = catalog._profiles(spark, data).persist(), sessions.since_reset(catalog.domain.events(spark, data))
    own = vectors.content_vectors(profiles).persist()
    preferences = sessions.preference_vectors(sessions.event_weights(sessions.recent(events)), own).persist()
    shared = preferences.select("session_id").distinct().crossJoin(profiles.select("item_id").limit(30)).withColumn("score", (F.col("item_id") % 7).cast("double"))
    seen = events.filter("item_id is not null")
    rows = lambda df: sorted((r.session_id, r.item_id, r.bucket, round(r.value, 8)) for r in df.collect())
    want = rows(sessions.for_you_candidates(sessions.session_cosines(preferences, own), profiles, seen, 10, shared))
    for items in (100_000, 60):
        monkeypatch.setattr(sessions, "ITEMS_AT_ONCE", items)
        assert rows(sessions.for_you_everyone(preferences, own, profiles, seen, 10, shared)) == want and len({r[2] for r in want}) == 3


def test_bests_in_blocks_are_those_of_all_pairs(monkeypatch):
    """Ties, sessions without features or seen items, cosines of zero; items in the order of several tables."""
    import numpy as np
    import pyarrow as pa

    from starling.operators import sessions

    rng, n, most = np.random.default_rng(3), 900, 20
    vectors = [{int(k): round(float(x), 1) for k, x in zip(rng.choice(40, 5, replace=False), rng.normal(size=5)) if round(float(x), 1)} for _ in range(n // 3)] * 3
    ids, q = rng.permutation(10 * n)[:n], np.round(rng.random(n), 1)
    pool = set(ids[q >= 0.7].tolist())
    rows = [(int(i), float(g), f, x) for i, g, v in zip(ids, q, vectors) for f, x in v.items()]
    tables = [pa.table(dict(zip(("item_id", "q", "f", "value"), map(list, zip(*[r for r in rows if r[0] % 3 == k]))))) for k in range(3)]
    items = sessions._together([sessions._by_item(t, pool) for t in tables])
    own = {}
    for k in range(30):
        f = rng.choice(50, 0 if k == 4 else 2 if k == 6 else 12, replace=False)
        a = np.zeros(len(f)) if k == 5 else np.round(rng.normal(size=len(f)), 1)
        own[k] = ({int(x): float(y) for x, y in zip(f, a)}, {int(x): float(y) for x, y in zip(f, np.round(rng.random(len(f)), 1))}, None if k % 4 == 0 else rng.choice(ids, 100).tolist(), None if k % 5 == 0 else rng.choice(10 * n, 300, replace=False).tolist())
    wanted = {}
    for k, (a, b, seen, item) in own.items():
        lists = ([], [], [])
        for i, g, v in zip(ids.tolist(), q, vectors):
            if not set(v) & set(a) or i in (seen or []):
                continue
            cosine, dislike = sum(a.get(f, 0.0) * x for f, x in v.items()), sum(b.get(f, 0.0) * x for f, x in v.items())
            if cosine > 0:
                lists[0].append((-round(100 * cosine + 18 * g, 8), i))
            if i in pool and dislike < sessions.VETO and (x := 100 * g + 12 * max(cosine, 0) - 35 * dislike) > 0:
                lists[1].append((-round(x, 8), i))
            if i in (item or []) and dislike < sessions.VETO:
                lists[2].append((-round(i % 7 + 14 * g - 30 * dislike, 8), i))
        wanted |= {(k, bucket): sorted(l)[: most if bucket < 2 else 15] for bucket, l in enumerate(lists)}
    rows = [(k, list(a), list(a.values()), list(b.values()), seen, item, [float(i % 7) for i in item] if item else None) for k, (a, b, seen, item) in own.items()]
    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
    batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=["session_id", "f", "a", "b", "seen", "item", "score"])
    sent = type("Sent", (), {"value": items})
    for at_once, block in ((256, 2048), (7, 64)):
        monkeypatch.setattr(sessions, "SESSIONS_AT_ONCE", at_once)
        monkeypatch.setattr(sessions, "ITEMS_IN_BLOCK", block)
        found = {k: [] for k in wanted}
        for out in sessions._bests(sent, most, 15)([batch]):
            for r in out.to_pylist():
                found[r["session_id"], r["bucket"]].append((-round(r["value"], 8), r["item_id"]))
        assert {k: sorted(l) for k, l in found.items()} == wanted


def test_only_the_first_of_equal_candidates_is_looked_at():
    looked = []

    class Value(float):
        def __add__(self, other):
            looked.append(self)
            return float(self) + other

    rows = [("interest", k + 1, k, Value(100 - k / 10), ["a", "b"], ["t"]) for k in range(150)] + [("interest", 151, 500, Value(84.0), ["c"], [])]
    assert [r[2] for r in L._by_quota(rows, {"c": 1}, 3)] == [0, 500, 1] and len(looked) <= 6
