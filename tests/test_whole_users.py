from pyspark.sql import functions as F

from starling.plans import catalog

DATA = "/root/testdata/sf0.01"


def enough(spark, rows, least=12):
    return {r.user_id for r in rows.groupBy("user_id").count().filter(F.col("count") >= least).collect()}


def test_every_user_gets_als_recs(spark):
    want = enough(spark, catalog._split(spark, DATA).filter("split = 'train'"))
    got = catalog.QUERIES["als_recs"](spark, DATA).groupBy("user_id").count().collect()
    assert len(want) > 160 and {r.user_id for r in got} == want and {r["count"] for r in got} == {10}


def test_ltr_features_come_from_models_for_every_user(spark):
    rows = catalog.ev.three_way_split(catalog.domain.ratings(spark, DATA), min_ratings=12)
    want = enough(spark, rows.filter("split = 'train'"))
    matrix = catalog._ltr_matrix(spark, DATA).toPandas()
    assert set(matrix.user_id) == want and len(want) > 160 and not matrix.duplicated(["user_id", "item_id"]).any()
    for name in ("mf", "positive_similarity", "negative_similarity", "item_item", "cf", "route_score", "route_mf_user_top", "route_profile_centroid"):
        assert matrix[name].nunique() > 1, name


def test_recall_pool_has_every_route(spark):
    found = catalog.QUERIES["recall_pool"](spark, DATA).collect()
    assert {s for r in found for s in r.sources.split("|")} == set(catalog.recall.PRIORS)
