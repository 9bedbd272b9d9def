import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from starling.plans import catalog, details  # noqa: F401

DATA = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 20


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_its_oracle(spark, name):
    got = catalog.QUERIES[name](spark, DATA)
    if name not in catalog.ORACLES:
        assert got.limit(1).count() == 1
        return
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in ("lineitem", "orders", "part", "events", "embeddings", "customer", "nation", "region"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(catalog.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda v: f"{v:.9f}" if isinstance(v, float) else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)
    rows = lambda df: sorted(tuple(text(v) for v in r) for r in df[columns].itertuples(index=False))
    assert rows(got.toPandas()) == rows(want)
