import json
import threading
from urllib.request import urlopen

import pytest

from starling import __main__ as cli, pipelines
from starling.service import Service, serve

DATA = "/root/testdata/sf0.001"


def run(spark, *command, dataset="tables", data=DATA):
    return cli.run(cli.parser().parse_args(["--dataset", dataset, "--data", data, *command]), spark)


def test_queries(spark):
    assert run(spark, "top", "-n", "3", "--mode", "preference_adjusted")["count"] == 3
    assert run(spark, "demo")["dashboard"]["items"] == 200
    title = run(spark, "top", "-n", "1")["items"][0]["title"]
    assert run(spark, "search", "title", title)["count"] >= 1
    assert run(spark, "recommend", title, "-n", "2")["items"]
    with pytest.raises(SystemExit):
        run(spark, "top", "--algorithm", "bubble")


def test_rerank_writes_its_outputs_and_serves(spark, tmp_path):
    from starling.operators.rerank import FEATURES
    from starling.sources.files import read_artifact

    out = str(tmp_path / "out")
    metrics = {m["algorithm"]: m for m in run(spark, "rerank", "--profile", "smoke", "--output-dir", out)}
    assert set(metrics) == {"popular", "user_user", "als_biased", "hybrid", "stacked_linear", "pairwise_linear", "residual_linear", "mmr_stacked"}
    assert all(0 <= m["precision_at_k"] <= 1 and m["users"] > 0 for m in metrics.values())
    weights, summary = read_artifact(spark, out, FEATURES)
    assert sum(r.weight != 0 for r in weights.collect()) > 15 and summary["config"]["candidate_limit"] == 300 and summary["best_metric"]["algorithm"] in metrics
    for name in ("metrics", "blend_tuning", "residual_tuning", "candidate_recall", "mf_training"):
        assert spark.read.option("header", True).csv(f"{out}/{name}").count() > 0, name


def test_searches_resume(spark, tmp_path, monkeypatch):
    from starling import drivers

    data, plan, folder = pipelines.tables(spark, DATA), drivers.SearchPlan((20,), 20, 20, 60), str(tmp_path / "large")
    grids = {"mf_grid": [{"factors": 4, "iterations": 2, "reg": 0.04}], "weights": [(0.1, 0.0, 0.9), (0.2, 0.05, 0.75)]}
    best = drivers.large_search(data, folder, plan, **grids).collect()
    assert {r.source for r in best} == {"scale_comparison", "mf_search", "hybrid_search"}
    sizes = lambda: [spark.read.parquet(f"{folder}/{n}").count() for n in ("scale_comparison", "mf_search", "hybrid_search")]
    assert sizes() == [5, 1, 2]
    monkeypatch.setattr(drivers, "compare", None)
    drivers.large_search(data, folder, plan, **grids)
    assert sizes() == [5, 1, 2] and len(drivers.hybrid_weights()) > 30


def test_bayes_modes(spark, tmp_path):
    from starling import drivers
    from starling.operators import evaluation as ev, tuning

    data, config = pipelines.tables(spark, DATA), ev.Config(max_users=20, pool=60)
    for mode in ("hybrid", "recall"):
        found = drivers.bayes_search(data, str(tmp_path / mode), mode, 2, config)
        assert set(found["best_params"]) == set(tuning.SPACES[mode]) and isinstance(found["best_metrics"]["objective"], float)
        again = drivers.bayes_search(data, str(tmp_path / mode), mode, 2, config)
        assert again["best_params"] == found["best_params"]
    settings = drivers.load_recall_settings(spark, str(tmp_path / "recall/best_params.json"))
    assert len(settings["priors"]) == 6 and 20 <= settings["rrf_k"] <= 140
    with pytest.raises(ValueError):
        drivers.objective(data, "other", config)


def test_small_catalogues_have_no_learning(spark, tmp_path):
    for name, head in (("movies", "movieId,title,genres"), ("ratings", "userId,movieId,rating,timestamp"), ("tags", "userId,movieId,tag,timestamp")):
        (tmp_path / f"{name}.csv").write_text(head + "\n")
    with pytest.raises(NotImplementedError):
        run(spark, "rerank", dataset="small", data=str(tmp_path))


def test_http(spark):
    server = serve(Service(pipelines.tables(spark, DATA)), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        with urlopen(f"http://127.0.0.1:{server.server_port}/api/top?n=2", timeout=120) as r:
            assert json.load(r)["count"] == 2
    finally:
        server.shutdown()
