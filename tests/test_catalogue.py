"""Every query of the engine's own operators against its SQL on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return str(v.normalize() + 0)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return v


@pytest.mark.parametrize("name", list(catalogue.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((str([plain(r[c]) for c in columns]) for r in df.collect()))
    r = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted(str([plain(dict(zip(names, row))[c]) for c in columns]) for row in r.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n not in catalogue.ORACLES])
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert 0 < __spark_entry__.entry(spark).count() <= 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_all_models_in_order(spark, duck):
    """Every row, in the SQL's order; model_order's given SQL stops at 10."""
    got = [tuple(r[c] for c in ("id", "name", "sort_order")) for r in catalogue.QUERIES["model_list"](spark, SF).collect()]
    assert len(got) == spark.read.parquet(f"{SF}/supplier.parquet").count()
    assert got == duck.execute(catalogue.ORACLES["model_list"]).fetchall()
