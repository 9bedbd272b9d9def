import json

import pytest

from starling import pipelines
from starling.operators.rerank import FEATURES
from starling.service import Service, respond
from starling.sources import files as S


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "small"
    d.mkdir()
    titles = ["Toy Story (1995)", '"Matrix, The (1999)"', "Heat (1995)", "Toy Story 2 (1999)", "Unrated (2000)"]
    genres = ["Comedy|Animation", "Action|Sci-Fi", "Action|Crime", "Comedy|Animation", "(no genres listed)"]
    (d / "movies.csv").write_text("movieId,title,genres\n" + "".join(f"{i},{t},{g}\n" for i, (t, g) in enumerate(zip(titles, genres), 1)))
    rows = [(u, i, (u * i) % 5 + 1, 1_600_000_000 + 86_400 * u) for u in range(1, 9) for i in range(1, 5)]
    (d / "ratings.csv").write_text("userId,movieId,rating,timestamp\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    (d / "tags.csv").write_text("userId,movieId,tag,timestamp\n1,1,pixar,1\n2,1,fun,1\n1,4,Pixar,1\n3,2,\"cyber, punk\",1\n")
    return str(d)


def test_small_files(spark, folder):
    data = pipelines.small(spark, folder)
    got = {r.item_id: r for r in data.items.collect()}
    assert got[2].title == "Matrix, The (1999)" and got[2].release_year == 1999 and got[5].genres == [] and data.ratings.count() == 32
    with pytest.raises(ValueError):
        pipelines.load(spark, "nope", folder)


def test_large_files(spark, tmp_path):
    (tmp_path / "training_set").mkdir()
    (tmp_path / "movie_titles.txt").write_bytes("1,2003,Café, the Movie\n2,NULL,Two\n".encode("latin-1"))
    (tmp_path / "training_set/mv_0000001.txt").write_text("1:\n10,5,2005-01-02\n11,3,2005-01-03\n")
    (tmp_path / "training_set/mv_0000002.txt").write_text("2:\n10,1,2005-02-02\n")
    data = pipelines.large(spark, str(tmp_path))
    assert {(r.item_id, r.release_year, r.title) for r in data.items.collect()} == {(1, 2003, "Café, the Movie"), (2, None, "Two")}
    assert {(r.user_id, r.item_id, r.rating, str(r.ts)) for r in data.ratings.collect()} == {(10, 1, 5.0, "2005-01-02"), (11, 1, 3.0, "2005-01-03"), (10, 2, 1.0, "2005-02-02")}
    assert pipelines.large(spark, str(tmp_path), 1).ratings.count() == 2
    (tmp_path / "bad.txt").write_text("1;2003;x\n")
    with pytest.raises(Exception, match="not a title line"):
        S.read_titles(spark, f"{tmp_path}/bad.txt").collect()


def test_event_log(spark, tmp_path):
    lines = [json.dumps({"session_id": "s" * 200, "event_type": "search", "timestamp": 1.5, "query": "q" * 300}), "{broken", json.dumps({"session_id": "a", "event_type": "jump"}), json.dumps({"session_id": "a", "event_type": "like", "movie_id": 3})]
    (tmp_path / "log.json").write_text("\n".join(lines))
    got = S.read_events(spark, str(tmp_path / "log.json")).collect()
    assert [(len(r.session_id), r.event_type, len(r.query or "")) for r in got] == [(120, "search", 160), (1, "like", 0)] and got[1].timestamp > 1e9
    S.append_events(S.read_events(spark, str(tmp_path / "log.json")), str(tmp_path / "again"))
    assert S.read_events(spark, str(tmp_path / "again")).count() == 2


def test_artifact_signature_cache_and_sinks(spark, tmp_path):
    (tmp_path / "feature_weights.csv").write_text("feature,weight,mean,std\nmf,2.0,0.5,0\n")
    (tmp_path / "summary.json").write_text('{"config": {"candidate_limit": 60}}')
    rows, summary = S.read_artifact(spark, str(tmp_path), FEATURES)
    got = {r.feature: r for r in rows.collect()}
    assert len(got) == 25 and got["mf"].std == 1e-6 and got["cf"].weight == 0 and summary["config"]["candidate_limit"] == 60
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "i int, s string")
    assert S.signature(df) == S.signature(df.repartition(3)) != S.signature(df.distinct())
    made = []
    for _ in range(2):
        assert S.cached(spark, str(tmp_path), "key", lambda: made.append(1) or df).count() == 3
    assert len(made) == 1
    S.write_rows_csv([df, spark.createDataFrame([(5, 1.5)], "i int, x double")], f"{tmp_path}/rows")
    assert spark.read.option("header", True).csv(f"{tmp_path}/rows").columns == ["i", "s", "x"]
    S.write_metadata(spark, {"b": 2, "a": "x"}, f"{tmp_path}/meta")
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/meta").collect()) == [("a", "x"), ("b", "2")]
    metrics = spark.createDataFrame([("m1", 0.1, 0.2, 0.3), ("m2", 0.1, 0.4, 0.1)], "algorithm string, precision_at_k double, hit_rate_at_k double, map_at_k double")
    S.write_summary({"k": 10}, metrics, f"{tmp_path}/summary")
    assert json.loads(spark.read.json(f"{tmp_path}/summary").first().best_metric)["algorithm"] == "m2"
    with pytest.raises(ValueError):
        S.inline_ratings(spark, [(1, float("nan"))])
    assert "<polyline" in S.runtime_chart([("a", 1, 0.1), ("a", 2, 0.2)])


def test_requests(spark, folder):
    service = Service(pipelines.small(spark, folder))
    get = lambda path: respond(service, "GET", f"/api/{path}")
    assert get("health")[1] == {"ok": True, "dataset": "small", "default": "small", "available": ["small"]} and get("dashboard")[1]["ratings"] == 32
    status, found = get("top?n=2&algorithm=merge&score_mode=preference_adjusted")
    assert status == 200 and found["count"] == 2 and found["score_key"].startswith("preference")
    assert get("top?n=0")[0] == get("top?n=3&algorithm=bubble")[0] == get("health?dataset=x")[0] == get("search?kind=actor&query=x")[0] == get("top?bogus=1")[0] == 400
    assert get("nothing")[0] == 404 and respond(service, "POST", "/api/top")[0] == 405
    status, found = get("search?kind=title&query=toy%20stry&n=1")
    assert status == 200 and found["count"] >= 1 and len(found["items"]) == 1
    status, found = get("recommend?title=toy%20story&n=3")
    assert found["target"]["item_id"] == 1 and found["items"][0]["item_id"] == 4
    assert not get("for-you?session_id=s&n=3")[1]["personalised"]
    for k, item in enumerate((1, 2)):
        assert respond(service, "POST", "/api/events", json.dumps({"session_id": "s", "event_type": "like", "movie_id": item}).encode()) == (200, {"ok": True, "event_count": k + 1})
    assert respond(service, "POST", "/api/events", b'{"session_id": "s", "event_type": "jump"}')[0] == 400
    found = get("for-you?session_id=s&n=3")[1]
    assert found["personalised"] and found["items"] and not {1, 2} & {r["item_id"] for r in found["items"]}
    assert respond(service, "POST", "/api/events", b'{"session_id": "s", "event_type": "reset"}')[1]["event_count"] == 0
    assert get("tag-semantics?tag=fun")[0] == 200
    service.data.tags = None
    assert get("tag-semantics?tag=fun")[0] == 501


def test_events_outlive_the_process(spark, folder, tmp_path):
    data, log = pipelines.small(spark, folder), str(tmp_path / "events")
    post = lambda service, **event: respond(service, "POST", "/api/events", json.dumps(event).encode())
    one = Service(data, events=log)
    for item in (1, 2):
        assert post(one, session_id="s", event_type="like", movie_id=item)[0] == 200
    assert post(one, session_id="t" * 300, event_type="search", query="q" * 400)[1] == {"ok": True, "event_count": 1}
    two = Service(data, events=log)
    assert post(two, session_id="s", event_type="view", movieId=3)[1]["event_count"] == 3
    assert [e["movie_id"] for e in Service(data, events=log).log.of("s")] == [1, 2, 3]
    long = Service(data, events=log).log.of("t" * 300)
    assert len(long[0]["session_id"]) == 120 and len(long[0]["query"]) == 160
    assert post(two, session_id="s", event_type="reset")[1]["event_count"] == 0 and Service(data, events=log).log.of("s") == []
    assert post(two, session_id="s", event_type="like", movie_id=4)[1]["event_count"] == 1 and len(Service(data, events=log).log.of("s")) == 1
    few = S.EventLog(spark, log, most=2, sessions=1)
    few.of("s")
    few.of("other")
    assert list(few.known) == ["other"]


def test_several_datasets_on_one_port(spark, folder):
    services = {"small": Service(pipelines.small(spark, folder)), "tables": Service(pipelines.tables(spark, "/root/testdata/sf0.001"))}
    assert respond(services, "GET", "/api/health")[1]["available"] == ["small", "tables"]
    assert respond(services, "GET", "/api/health?dataset=tables")[1]["dataset"] == "tables"
    assert respond(services, "GET", "/api/dashboard?dataset=tables")[1]["items"] == 200
    assert respond(services, "GET", "/api/top?dataset=none")[0] == 400


def large(spark):
    ratings = [(u, i, 5.0 if (u + i) % 3 else 2.0) for u in range(30) for i in range(40) if (u * 7 + i * 3) % 4]
    items = spark.createDataFrame([(i, f"title {i}", [], 1980 + i % 20 if i % 9 else None) for i in range(40)], "item_id long, title string, genres array<string>, release_year int")
    rows = spark.createDataFrame(ratings, "user_id long, item_id long, rating double").selectExpr("*", "timestamp_seconds(user_id * 1000 + item_id) AS ts")
    return pipelines.Dataset("large", "Large", items, rows)


def test_the_reranker_answers_first(spark, tmp_path):
    from starling.operators import factors

    data = large(spark)
    weights = {"quality": (1.0, 0.5, 0.2), "route_user_user_cf": (0.5, 0.1, 0.3), "mf": (0.5, 0.5, 0.2)}
    S.write_artifact(weights, {"config": {"candidate_limit": 60, "candidate_recall_rrf_k": 20.0, "candidate_recall_priors": [["user_user_cf", 0.1, 0.9, 1.0], ["item_item_cf", 0.1, 0.9, 1.0], ["popular_quality", 0.1, 0.9, 1.0], ["mf_user_top", 0.1, 0.9, 1.0], ["profile_centroid", 0.1, 0.9, 1.0], ["year_affinity", 0.1, 0.9, 1.0]]}, "best_metric": {"precision_at_k": 0.5}}, str(tmp_path / "a"), spark)
    events = [("like", 1), ("like", 4), ("dislike", 2), ("search", None)]

    def answer(artifact, n=6):
        service = Service(data, artifact=artifact)
        for kind, item in events:
            service.event("s", kind, item)
        return service.for_you("s", n)

    plain, by_reranker = answer(None), answer(str(tmp_path / "a"))
    assert plain["engine"] == "user_user" and by_reranker["engine"] == "stacked_reranker" and by_reranker["status"] == "personalized"
    assert by_reranker["event_count"] == 4 and by_reranker["model"]["candidate_limit"] == 60 and not by_reranker["model"]["factors"]
    for found in (plain, by_reranker):
        assert found["count"] == 6 and not {1, 2, 4} & {i["item_id"] for i in found["items"]} and sum(found["bucket_counts"].values()) == 6
    assert "user_user_cf" in by_reranker["routes"] and by_reranker["collaborative"]["neighbor_count"] > 0
    factors.fit(data.ratings, factors.Config(factors=4, iterations=3)).save(str(tmp_path / "a/model"))
    assert answer(str(tmp_path / "a"))["model"]["factors"] and answer(str(tmp_path / "nothing"))["engine"] == "user_user"
    assert Service(data).for_you("new", 3)["status"] == "cold_start"
    assert Service(data).user(3, 4)["count"] == 4 or Service(data).user(3, 4)["status"] == "cold_start"


def test_online_year_and_profile_routes_score_every_item(spark):
    """A session's year route is the first 800 of all items, not of the best ones."""
    from starling.operators import recommend as O

    n = 4000
    scores = spark.range(n).selectExpr("id AS item_id", "CAST(1900 + id % 100 AS INT) AS release_year", "CAST(5 * (1 - id / 4000) AS DOUBLE) AS avg_rating", "CAST(100 - id / 50 AS DOUBLE) AS comprehensive_score", "CAST(3.0 AS DOUBLE) AS bayesian_rating", "10L AS rating_count", "CAST(id AS STRING) AS title")
    ratings = spark.createDataFrame([(1, 3950, 5.0), (2, 3950, 4.0)], "user_id long, item_id long, rating double")
    profile = spark.createDataFrame([("s", 3950, 5.0)], "session_id string, item_id long, rating double")
    found = O.online_routes(profile, scores, ratings).filter("source = 'year_affinity'").toPandas()
    rows = scores.toPandas()
    import numpy as np

    value = 0.7 * np.exp(-abs(rows.release_year - 1950) / 18) + 0.3 * rows.comprehensive_score / rows.comprehensive_score.max()
    want = sorted((i for i in range(n) if i != 3950), key=lambda i: (-round(value[i], 6), i))[:800]
    assert set(found.item_id) == set(want) and max(want) > 3200


def test_tables_decisions_and_sinks(spark, folder, tmp_path):
    data, made = pipelines.small(spark, folder), []
    d = str(tmp_path)
    S.write_statistics(data.ratings, data.scores.drop("tag_details"), f"{d}/stats")
    assert set(S.table_columns(spark, f"{d}/stats/user_norms")) == {"user_id", "rating_norm"} and S.table_columns(spark, f"{d}/none") == []
    build = lambda: made.append(1) or data.items.select("item_id", "title")
    for columns, builds in ((["item_id"], 1), (["title"], 1), (["item_id", "title"], 1)):
        assert S.stored(spark, f"{d}/items", columns, build).count() == 5 and len(made) == builds
    S.publish(data.items.select("item_id"), f"{d}/items")
    assert spark.read.parquet(f"{d}/items").columns == ["item_id"] and S.stored(spark, f"{d}/items", ["title"], build).count() == 5 and len(made) == 2
    assert S.insert_rows(spark.createDataFrame([("7", "x")], "a string, t string"), f"{d}/typed", "a int, t string").first().a == 7
    assert S.insert_rows(spark.createDataFrame([("8", "x")], "a string, t string"), f"{d}/typed", "a int, t string").count() == 2
    for decision in ("accept", "reject"):
        S.write_decision(spark, f"{d}/decisions", " Sci-Fi", "scifi", decision)
    with pytest.raises(ValueError):
        S.write_decision(spark, f"{d}/decisions", "a", "b", "maybe")
    from starling.operators.aliases import latest_decisions

    assert [(r.source, r.decision) for r in latest_decisions(S.read_decisions(spark, f"{d}/decisions")).collect()] == [("sci-fi", "reject")]
    S.write_profiles_csv(data.scores, f"{d}/profiles")
    raw = next((tmp_path / "profiles").glob("part-*.csv")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbfmovieId,title,genres,avg_rating") and len(raw.split(b"\n")[0].split(b",")) == 20
