"""Every registered query against its SQL, on the smallest tables, where they are at hand."""

import datetime
import glob
import math
import os

import pytest

import __spark_entry__ as entry_module

DATA = os.environ.get("KHATA_TEST_DATA", "/root/testdata/sf0.001")
CORE = __import__("khata.plans.registry", fromlist=["x"])


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (int, str)):
        return str(v)
    return format(float(v), ".9g")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(CORE.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = CORE.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    theirs = duck.sql(CORE.oracle_sql()[name])
    assert sorted(theirs.columns) == columns
    at = [theirs.columns.index(c) for c in columns]
    assert ours == sorted(tuple(plain(r[i]) for i in at) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(CORE.queries()) - set(CORE.oracle_sql())))
def test_other_queries_run(spark, duck, name):
    assert CORE.queries()[name](spark, DATA).count() > 0


def test_entry(spark, duck):
    assert entry_module.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_no_cartesian_product_or_single_partition_window_on_rows(spark, duck):
    for name in ("word_budget", "words_before", "pack_sequences", "base_dedup_capped"):
        plan = CORE.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
