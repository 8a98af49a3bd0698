import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from khata.operators import dedup, ordered


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(weights=st.lists(st.one_of(st.none(), st.integers(0, 50)), max_size=30))
def test_prefix_sum_is_the_running_sum(spark, weights):
    df = spark.createDataFrame(list(enumerate(weights)), "i LONG, w LONG")
    got = {r["i"]: r["s"] for r in ordered.prefix_sum(df, "w", "i", "s", bucket=7).collect()}
    total, expected = 0, {}
    for i, w in enumerate(weights):
        expected[i] = total
        total += w or 0
    assert got == expected


def test_prefix_sum_within_null_groups(spark, rows):
    df = spark.createDataFrame([(1, None, 5), (2, "a", 1), (3, None, 2), (4, "a", 3)], "i LONG, g STRING, w LONG")
    assert rows(ordered.prefix_sum(df, "w", "i", "s", ["g"], bucket=2).select("i", "g", "s")) == [(1, None, 0), (2, "a", 0), (3, None, 5), (4, "a", 1)]


def test_budget_overshoots_by_the_last_row(spark, rows):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "i LONG, w LONG")
    assert rows(ordered.greedy_budget(df, "w", "i", 7).select("i")) == [(1,), (2,)]
    assert ordered.greedy_budget(df, "w", "i", 0).count() == 3


def test_quantiles_by_index(spark):
    of = lambda values: ordered.index_quantiles(spark.createDataFrame([(v,) for v in values], "v LONG"), "v", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).first()
    assert of([3, 1, 0, 2])["p50"] == 2
    assert tuple(of(range(10))) == (1, 5, 9)
    assert tuple(of([])) == (None, None, None)
    rnd = random.Random(1)
    many = [rnd.randrange(20) for _ in range(101)]
    assert tuple(of(many)) == tuple(sorted(many)[int(101 * s)] for s in (0.1, 0.5, 0.9))


def test_interleave_keeps_each_order(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(9)], "i LONG, s STRING")
    out = [(r["s"], r["i"]) for r in ordered.interleaved(df, "i", "s").orderBy("place", "s").collect()]
    for s in "ab":
        own = [i for k, i in out if k == s]
        assert own == sorted(own)


DOCS = [(1, "t", "titullm", 2), (2, "t", "wiki", 1), (3, "t", "titullm", 2), (4, "u", "titullm", 2), (5, None, "wiki", 1)]


def test_first_wins_by_priority_with_absorber(spark, rows):
    df = spark.createDataFrame(DOCS, "doc_id LONG, text STRING, source STRING, priority INT")
    key = dedup.digest("text", False)
    assert rows(dedup.first_wins(df, key).select("doc_id")) == [(2,), (4,)]
    table = {r["source"]: tuple(r)[1:] for r in dedup.attribution(dedup.marked(df, key)).collect()}
    assert table == {"titullm": (3, 1, 2, 0), "wiki": (1, 1, 0, 2)}
    assert tuple(dedup.summary(df, key).first()) == (4, 2, 2, 50.0)
    assert rows(dedup.group_sizes(df, key)) == [(1, 1), (3, 1)]


def test_base_comes_before_repeats(spark, rows):
    base = spark.createDataFrame([("x",), (None,)], "h STRING")
    more = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, None)], "doc_id LONG, h STRING")
    assert rows(dedup.against_base(more, base).select("doc_id", "state")) == [(1, "base"), (2, "base"), (3, "kept"), (4, "self"), (5, "empty")]
    assert dedup.against_base(more.limit(0), base).count() == 0


def test_permutation_and_split(spark):
    df = spark.range(50)
    a = [r["id"] for r in ordered.permuted(df, "id", 1, 0).orderBy("shuffle_key").collect()]
    b = [r["id"] for r in ordered.permuted(df, "id", 1, 1).orderBy("shuffle_key").collect()]
    assert sorted(a) == sorted(b) == list(range(50)) and a != b
    share = ordered.hash_split(spark.range(2000), "id", 0.2, 42).where(F.col("split") == "test").count() / 2000
    assert 0.15 < share < 0.25


@pytest.mark.parametrize("order", ["cast(xxhash64(id) as bigint)", "id / 1000.0", "id * id", "cast(1000 - id as int)", "5"])
def test_prefix_sums_over_any_numbers(spark, monkeypatch, order):
    monkeypatch.setattr(ordered, "BUCKET", 50)
    df = spark.range(300).selectExpr("id", f"{order} as o", "id % 7 as w")
    got = {r["id"]: r["s"] for r in ordered.prefix_sum(df, "w", "o", "s", ties=["id"]).collect()}
    total, expected = 0, {}
    for r in sorted(df.collect(), key=lambda r: (r["o"], r["id"])):
        expected[r["id"]] = total
        total += r["w"]
    assert got == expected
    buckets = df.select(ordered.bucket_of(df, "o", 50).alias("b")).distinct().count()
    assert buckets <= 8  # a few for a few rows each, whatever the numbers


def test_rows_without_a_key_are_empty(spark, rows):
    own = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, None), (5, "b")], "doc_id LONG, h STRING")
    base = spark.createDataFrame([("b",), (None,)], "h STRING")
    assert rows(dedup.against_base(own, base).select("doc_id", "state")) == [(1, "empty"), (2, "kept"), (3, "self"), (4, "empty"), (5, "base")]
