"""Every query against its SQL, on the smallest tables."""

import duckdb
import pytest

from tidewheel import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str([None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in row]).replace(".0,", ",").replace(".0]", "]") for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_sql(spark, duck, name):
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(duck.sql(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
