import random

import pytest

from strandframe.operators.ordering import numbered, numbered_within, running_total


@pytest.fixture(params=["true", "false"])
def coalesce(spark, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_follow_the_order(spark, coalesce):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i) for i in rng.sample(range(5000), 2000)]
    df = spark.createDataFrame(rows, "g string, i long").repartition(5)
    got = numbered(df, ["i"], "k").orderBy("k").collect()
    assert [r.i for r in got] == sorted(i for _, i in rows) and [r.k for r in got] == list(range(2000))
    for g in ("a", "b", None):
        own = sorted((r.k, r.i) for r in numbered_within(df, ["g"], ["i"], "k").collect() if r.g == g)
        assert own == list(enumerate(sorted(i for x, i in rows if x == g)))


def test_running_totals(spark, coalesce):
    rows = [(i * 7 % 1009, i % 5) for i in range(1009)]
    got = {r.v: r.total for r in running_total(spark.createDataFrame(rows, "v long, n long").repartition(5), ["v"], "n", "total").collect()}
    total = 0
    for v, n in sorted(rows):
        total += n
        assert got[v] == total


def test_empty_tables(spark):
    df = spark.createDataFrame([], "g string, i long")
    assert numbered(df, ["i"], "k").count() == 0 and numbered_within(df, ["g"], ["i"], "k").count() == 0 and running_total(df, ["i"], "i", "t").count() == 0
