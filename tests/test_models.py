import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starling.operators import aliases, evaluation as E, factors, recall as R, rerank as K, tuning as T, vectors as V


def timed(spark, users=3, days=10):
    rows = [(u, d, float((u + d) % 5 + 1), f"2024-01-{d + 1:02d}") for u in range(users) for d in range(days)]
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double, t string").withColumn("ts", F.to_timestamp("t")).drop("t")


def test_splits_are_disjoint_and_in_time_order(spark):
    rows = E.time_split(timed(spark, days=12), 0.2).collect()
    for u in range(3):
        train, test = ([r.ts for r in rows if r.user_id == u and r.split == s] for s in ("train", "test"))
        assert len(test) == 2 and len(train) == 10 and max(train) < min(test)
    parts = [r.split for r in E.three_way_split(timed(spark, users=2, days=12)).collect()]
    assert (parts.count("train"), parts.count("ranker"), parts.count("test")) == (16, 4, 4)
    assert E.fit_validation_split(timed(spark)).filter("part = 'validation'").count() == 15
    assert E.three_way_split(timed(spark, days=2), min_ratings=1).count() == 0


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 10, 1), (3, 10, 1)], "user_id long, item_id long, rank int")
    relevant = spark.createDataFrame([(1, 10), (1, 12), (2, 99), (4, 1)], "user_id long, item_id long")
    m = E.ranking_metrics(ranked, relevant, 3, 10).first()
    assert m.users == 3 and m.precision_at_k == round(2 / 3 / 3, 6) and m.hit_rate_at_k == round(1 / 3, 6)
    assert m.map_at_k == round((1 + 2 / 3) / 2 / 3, 6) and m.catalog_coverage == 0.3


def test_factors_learn_order_and_save(spark, tmp_path):
    rng = random.Random(2)
    rows = [(u, i, 5.0 if (u + i) % 2 == 0 else 1.0) for u in range(30) for i in range(20) if rng.random() < 0.6]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    model = factors.fit(ratings, factors.Config(factors=4, iterations=8))
    test = spark.createDataFrame([(u, i, 5.0 if (u + i) % 2 == 0 else 1.0) for u in range(30) for i in range(20)], "user_id long, item_id long, rating double")
    assert E.rmse(model.predict(test)).first().rmse < 1.0
    model.save(str(tmp_path / "m"))
    again = factors.Model.load(spark, str(tmp_path / "m"))
    pairs = test.filter("user_id < 3").union(spark.createDataFrame([(999, 1, 0.0), (1, 999, 0.0), (999, 999, 0.0)], "user_id long, item_id long, rating double"))
    a, b = ({(r.user_id, r.item_id): r.prediction for r in m.predict(pairs).collect()} for m in (model, again))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a) and abs(a[999, 999] - model.mu) < 1e-9
    recs = model.recommend(ratings.select("user_id"), ratings, ratings, 3)
    assert recs.join(ratings, ["user_id", "item_id"], "left_semi").count() == 0


def test_quotas_and_weights():
    metrics = {s: (0.1, 0.1, 0.02) for s in R.PRIORS}
    q = R.quotas(1000, metrics)
    assert sum(q.values()) <= 1000 and all(int(1000 * p.floor) <= q[s] <= int(1000 * p.cap) for s, p in R.PRIORS.items())
    assert R.weights(metrics)["popular_quality"] > R.weights(metrics)["user_user_cf"] > 0
    with pytest.raises(ValueError):
        R.Prior(0.5, 0.2, 1.0)
    assert (R.per_user_limit(600, 0, 10), R.per_user_limit(0, 5, 10), R.per_user_limit(600, 160, 10)) == (10, 80, 37)


def test_fusion_does_not_depend_on_order(spark):
    routes = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 2.0), ("a", 3, 1.0), ("b", 3, 9.0), ("b", 4, 8.0)], "source string, item_id long, score double")
    one, two = ({r.item_id: (round(r.score, 9), r.sources) for r in R.rrf(df, {"a": 2, "b": 2}, {"a": 1.0, "b": 2.0}, 10).collect()} for df in (routes, routes.orderBy(F.desc("item_id")).repartition(3)))
    assert one == two == {1: (round(1 / 11, 9), ["a"]), 2: (round(1 / 12, 9), ["a"]), 3: (round(2 / 11, 9), ["b"]), 4: (round(2 / 12, 9), ["b"])}
    pool, found = R.build_pool(routes.replace({"a": "popular_quality", "b": "mf_user_top"}), spark.createDataFrame([(1,), (77,)], "item_id long"), spark.createDataFrame([(1, 0.5)], "item_id long, quality double"), 10, 20.0, backfill=True)
    assert {r.item_id for r in pool.collect()} >= {1, 77} and {r.source for r in found.collect()} == {"popular_quality", "mf_user_top"}


def matrix(spark):
    rng = random.Random(5)
    rows = [(u, i, int(i < 4), *[min(1.0, max(0.0, 0.7 * (i < 4) + 0.3 * rng.random())) for _ in K.FEATURES]) for u in range(8) for i in range(16)]
    return spark.createDataFrame(rows, "user_id long, item_id long, label int, " + ", ".join(f"{f} double" for f in K.FEATURES))


def test_rankers_put_positives_first(spark):
    rows = matrix(spark)
    for ranker in (K.fit_pointwise(rows), K.fit_pairwise(rows), K.fit_residual(rows, F.lit(0.5)), K.fit_neural(rows, hidden=8, iterations=30)):
        means = {r.label: r.m for r in ranker.score(rows).groupBy("label").agg(F.avg("ranker_score").alias("m")).collect()}
        assert means[1] > means[0]
    assert len(K.fit_pointwise(rows).weights()) == 25


def test_negatives(spark):
    rows = matrix(spark)
    hard = K.sample_negatives(rows, 2)
    assert hard.filter("label = 1").count() == 32 and hard.filter("label = 0").count() == 8 * 8
    weighted = [sorted((r.user_id, r.item_id) for r in K.sample_negatives(rows.repartition(n), 2, "explicit_hard").collect()) for n in (2, 5)]
    assert weighted[0] == weighted[1]
    assert K.hard_pairs(rows, F.col("mf")).count() == 8 * 4 * 4


def test_feature_matrix_is_complete(spark):
    train = timed(spark)
    items = spark.createDataFrame([(i, 1990 + i) for i in range(10)] + [(50, None)], "item_id long, release_year int")
    pairs = spark.createDataFrame([(0, 1), (0, 50), (77, 2)], "user_id long, item_id long")
    got = K.feature_matrix(pairs, train, items, E.quality_scores(train)).collect()
    assert len(got) == 3 and all(0 <= r[f] <= 1 for r in got for f in K.FEATURES)
    assert {r.item_id: r.has_year for r in got} == {1: 1.0, 50: 0.0, 2: 1.0}


def test_blend_and_tuning(spark):
    rows = spark.createDataFrame([(u, i, float(i == 3), float(i == 0)) for u in range(5) for i in range(6)], "user_id long, item_id long, learned double, base double")
    relevant = spark.createDataFrame([(u, 3) for u in range(5)], "user_id long, item_id long")
    best, table = T.tune_blend(rows, relevant, 1)
    assert best > 0.5 and table.count() == 21
    assert T.tune_blend(rows, relevant, 1, gain=2.0)[0] == 0.0
    residual = rows.select("user_id", "item_id", (0.4 - F.col("base") * 0.1).alias("base"), F.col("learned").alias("residual"))
    best, table = T.tune_residual(residual, relevant, 1)
    assert best > 0 and table.count() == 7
    mixed = rows.withColumn("b", K.blend(F.col("learned"), F.col("base"), 0.5, mode="rank")).agg(F.min("b"), F.max("b")).first()
    assert 0 <= mixed[0] <= mixed[1] <= 1


def test_objectives_and_trials(spark, tmp_path):
    m = {"precision_at_k": 0.1, "map_at_k": 0.1, "hit_rate_at_k": 0.1, "catalog_coverage": 0.5}
    assert T.ranking_objective(m) > T.ranking_objective(m | {"catalog_coverage": 0.0})
    good = {"route_recall": 0.5, "route_precision": 0.1, "route_marginal_recall_sum": 0.1}
    assert T.recall_objective(good | {"route_recall": 0.1}, 0.3, 100, 100) < 0 < T.recall_objective(good, 0.3, 100, 100)
    assert len(T.weight_grid(0.1)) == 21 and all(abs(sum(g.values()) - 1) < 1e-9 for g in T.weight_grid(0.1))
    calls = []
    work = lambda s: calls.append(s["trial_id"]) or {"objective": s["mf"]}
    T.run_trials(spark, T.trials("hybrid", 3), work, str(tmp_path / "log"))
    log = T.run_trials(spark, T.trials("hybrid", 5), work, str(tmp_path / "log"))
    assert len(calls) == 5 == log.count() and E.best_row(log, ["objective"]).count() == 1


def test_content_and_semantics(spark):
    tags = spark.createDataFrame([(i, t, 1.0) for i in range(12) for t in (["a", "b"] if i % 2 else ["c", "d"])], "item_id long, tag string, weight double")
    near = {(r.tag, r.neighbour) for r in V.tag_semantics(tags).collect()}
    assert near == {("a", "b"), ("b", "a"), ("c", "d"), ("d", "c")}
    expanded = {r.tag: round(r.weight, 3) for r in V.expand_tags(spark.createDataFrame([("a", 2.0), ("x", -1.0)], "tag string, weight double"), V.tag_semantics(tags)).collect()}
    assert expanded == {"a": 2.0, "x": -1.0, "b": 0.6}
    q = spark.createDataFrame([("f", 1.0), ("g", 1.0)], "feature string, value double")
    v = spark.createDataFrame([(1, "f", 2.0), (2, "f", 1.0), (2, "g", 1.0), (3, "h", 1.0)], "item_id long, feature string, value double")
    assert {r.item_id: round(r.cosine, 4) for r in V.cosine(v, q).collect()} == {1: 0.7071, 2: 1.0}


def test_aliases(spark):
    tags = spark.createDataFrame([(i, t) for i in range(9) for t in ("time travel", "time-travels")] + [(1, "great acting"), (2, "acting"), (3, "pg13 film"), (3, "r film")], "item_id long, tag string")
    got = aliases.alias_report(tags).collect()
    assert (got[0].source, got[0].target, got[0].band) == ("time-travels", "time travel", "high") or (got[0].target, got[0].source) == ("time-travels", "time travel")
    assert not any({r.source, r.target} & {"great acting", "pg13 film"} for r in got)
    decided = spark.createDataFrame([(got[0].source, got[0].target, "reject", 1.0), (got[0].source, got[0].target, "ignore", 2.0)], "source string, target string, decision string, ts double")
    assert aliases.latest_decisions(decided).first().decision == "ignore"
    assert aliases.alias_report(tags, decided).count() == len(got) - 1


def test_a_pool_in_blocks_gives_the_same_items(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(u, i, float(rng.randint(1, 5))) for u in range(25) for i in range(60) if rng.random() < 0.4]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, rating double")
    model = factors.fit(ratings, factors.Config(factors=4, iterations=4))
    whole = sorted(map(tuple, model.recommend(ratings, ratings, ratings, 7).collect()))
    for name, size in (("MOST_CANDIDATES", 10), ("ITEMS_IN_BLOCK", 9), ("USERS_IN_BLOCK", 4), ("USERS_AT_ONCE", 3)):
        monkeypatch.setattr(factors, name, size)
    assert sorted(map(tuple, model.recommend(ratings, ratings, ratings, 7).collect())) == whole and len(whole) == 25 * 7
    near = factors.centroids(ratings, model.items)
    assert model.near_centroids(near, ratings, ratings, 5).count() == 5 * near.count()


def test_history_falls(spark):
    rng = random.Random(2)
    rows = [(u, i, 5.0 if (u + i) % 2 == 0 else 1.0) for u in range(20) for i in range(15) if rng.random() < 0.6]
    found = factors.training_history(spark.createDataFrame(rows, "user_id long, item_id long, rating double"), factors.Config(factors=4, iterations=3))
    assert [r["iteration"] for r in found] == [1, 2, 3] and found[0]["rmse"] >= found[-1]["rmse"] - 1e-6


def test_split_top_equals_top(spark):
    from starling.functions.numeric import top, top_split

    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), "id", F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    assert sorted(map(tuple, top(rows, "g", order, 40).collect())) == sorted(map(tuple, top_split(rows, "g", order, 40, "id").collect()))


def test_tag_neighbours_have_no_cap_on_tags(spark):
    """5,000 tags in pairs that always come together."""
    rows = spark.range(15000).select(F.col("id").alias("item_id"), F.explode(F.array(*[F.concat(F.lit(side), (F.col("id") % 2500).cast("string")) for side in "ab"])).alias("tag"), F.lit(1.0).alias("weight"))
    got = V.tag_semantics(rows, dims=8).filter("substring(tag, 2, 9) = substring(neighbour, 2, 9)").count()
    assert got == 5000


def test_year_values_keep_the_best_of_each_year(spark):
    items = spark.createDataFrame([(i, 1950 + i % 40) for i in range(200)], "item_id long, release_year int")
    quality = spark.createDataFrame([(i, (i * 37 % 100) / 100) for i in range(200)], "item_id long, quality double")
    profile = spark.createDataFrame([(u, u * 7, 5.0) for u in range(20)], "user_id long, item_id long, rating double")
    best = lambda df: {(r.user_id, r.item_id) for r in df.withColumn("n", F.row_number().over(R.Window.partitionBy("user_id").orderBy(F.desc(F.round("value", 8)), "item_id"))).filter("n <= 9").collect()}
    assert best(R.year_values(profile, items, quality)) == best(R.year_values(profile, items, quality, 9))


def test_neural_takes_factors(spark):
    rows = matrix(spark)
    ratings = spark.createDataFrame([(u, i, 5.0 if i < 4 else 1.0) for u in range(8) for i in range(16)], "user_id long, item_id long, rating double")
    model = factors.fit(ratings, factors.Config(factors=3, iterations=3))
    ranker = K.fit_neural(rows, hidden=6, iterations=20, model=model)
    means = {r.label: r.m for r in ranker.score(rows).groupBy("label").agg(F.avg("ranker_score").alias("m")).collect()}
    assert means[1] > means[0] and ranker.pipeline.stages[-1].getLayers()[0] == 25 + 9


def test_als_lets_go_of_each_iterations_shuffles(spark, monkeypatch):
    made, als = [], factors.ALS
    monkeypatch.setattr(factors, "ALS", lambda **kw: made.append(als(**kw)) or made[-1])
    factors.fit(spark.createDataFrame([(u, i, float(1 + (u * i) % 5)) for u in range(6) for i in range(5)], "user_id long, item_id long, rating double"), factors.Config(factors=2, iterations=3))
    assert made[0].getCheckpointInterval() == 1 and spark.sparkContext.getCheckpointDir()


def test_ranked_leaves_out_history_inside_and_beyond_the_pool():
    rng = np.random.default_rng(4)
    ids, q = np.arange(10, 510, 5), rng.normal(size=(100, 3))
    history = [None, [], [10, 505], [0, 7, 12, 505, 506, 10**12], ids.tolist(), ids[3:].tolist()]
    users = [(u, [0.5, -1.0, float(u)], 0.0, own) for u, own in enumerate(history)]
    score = lambda v, b, q, c: v @ q.T
    found = factors._ranked(users, (ids, q, np.zeros(100)), 7, score)
    wanted = []
    for u, v, _, own in users:
        left = sorted((-round(float(s), 6), int(i)) for i, s in zip(ids, q @ np.array(v)) if int(i) not in set(own or []))[:7]
        wanted += [(u, i, -s, rank) for rank, (s, i) in enumerate(left, 1)]
    assert [(u, i, r) for u, i, _, r in found] == [(u, i, r) for u, i, _, r in wanted]
    assert np.allclose([x[2] for x in found], [x[2] for x in wanted])


def test_ranked_in_blocks_keeps_ties_by_id(monkeypatch):
    rng = np.random.default_rng(5)
    ids, q, c = np.arange(3, 903, 3), np.round(rng.normal(size=(300, 4)), 1), np.round(rng.normal(size=300), 1)
    users = [(f"u{u}", None if u == 3 else np.round(rng.normal(size=4), 1).tolist(), None if u % 2 else 1.0, rng.choice(ids, 40).tolist() if u % 3 else None) for u in range(20)]
    score = lambda v, b, q, c: np.where((s := np.clip(b[:, None] + c + v @ q.T, 0.0, 1.0)) == 0.5, -np.inf, s)
    whole = score(np.array([x[1] or [0.0] * 4 for x in users]), np.array([x[2] or 0.0 for x in users]), q, c)
    for n in (1, 9, 290, 400):
        wanted = []
        for (user, *_, own), row in zip(users, whole):
            left = sorted((-round(float(s), 6), int(i)) for i, s in zip(ids, row) if int(i) not in set(own or []) and s > -np.inf)[:n]
            wanted += [(user, i, -s, rank) for rank, (s, i) in enumerate(left, 1)]
        for size in (7, 64, 2048):
            monkeypatch.setattr(factors, "ITEMS_IN_BLOCK", size)
            assert factors._ranked(users, (ids, q, c), n, score) == wanted


def test_only_bests_of_large_parts_are_merged(spark, monkeypatch):
    """A pool of three parts gives each user at most three times n rows to merge, however many blocks the items have."""
    merged = []
    monkeypatch.setattr(factors, "top", lambda df, *a: merged.append(df.count()) or df)
    for name, size in (("MOST_CANDIDATES", 100), ("ITEMS_IN_BLOCK", 8), ("USERS_IN_BLOCK", 4)):
        monkeypatch.setattr(factors, name, size)
    rows = spark.range(300).select(F.col("id").alias("item_id"), F.array(F.col("id") / 300).alias("q"), F.lit(None).cast("double").alias("bias"))
    users = spark.range(20).select(F.col("id").alias("user_id"), F.array(F.lit(1.0)).alias("v"), F.lit(0.0).alias("bias"))
    factors.best_items(users, rows, spark.createDataFrame([(1, 299)], "user_id long, item_id long"), 5, lambda v, b, q, c: v @ q.T, "value")
    assert merged == [20 * 3 * 5]
