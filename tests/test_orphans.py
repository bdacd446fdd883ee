import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from strandframe.operators.orphans import integer_keys, orphan_references, parent_runs, reference_key

T0 = datetime(2024, 1, 1)
PARENT = "sample string, ref string, born timestamp, died timestamp"
REF = "id long, sample string, ref string, at timestamp"


def t(days):
    return None if days is None else T0 + timedelta(days=days)


def brute(refs, parents):
    out = set()
    for i, s, r, at in refs:
        if s is None or r is None:
            continue
        mine = [p for p in parents if p[0] == s and p[1] == r]
        if not mine:
            out.add((i, "missing"))
        elif at is not None and not any(p[2] is not None and p[2] <= at and (p[3] is None or p[3] > at) for p in mine):
            out.add((i, "late" if all(p[2] is not None and p[2] > at for p in mine) else "deleted"))
    return out


def run(spark, refs, parents):
    r = spark.createDataFrame(refs, REF).withColumn("born", F.lit(1)).withColumn("extra", F.lit("x"))
    p = spark.createDataFrame(parents, PARENT).withColumn("extra", F.lit("y"))
    got = orphan_references(r, p, ["sample", "ref"], "at", "born", "died")
    assert set(got.columns) == {"id", "sample", "ref", "at", "born", "extra", "kind"}
    return {(x.id, x.kind) for x in got.collect()}


def test_random_histories(spark):
    rng = random.Random(3)
    parents = []
    for k in range(60):
        day = rng.randrange(0, 50)
        for _ in range(rng.randrange(1, 4)):
            born, died = day, rng.choice([None, day + rng.randrange(0, 10)])
            parents += [(rng.choice(["a", "b"]), f"f{k % 30}", t(born), t(died))] * rng.choice([1, 1, 2])
            day += rng.randrange(0, 20)
    refs = [(i, rng.choice(["a", "b", None]), rng.choice([f"f{rng.randrange(40)}", None]), t(rng.choice([rng.randrange(0, 90), None]))) for i in range(800)]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_edges_of_a_life(spark):
    parents = [("a", "x", t(10), t(20)), ("a", "x", t(20), t(30)), ("a", "x", t(40), None)]
    refs = [(i, "a", "x", t(d)) for i, d in enumerate([9, 10, 19, 20, 29, 30, 39, 40, 99])]
    assert run(spark, refs, parents) == {(0, "late"), (5, "deleted"), (6, "deleted")}
    runs = parent_runs(spark.createDataFrame(parents, PARENT), ["sample", "ref"], "born", "died")
    assert runs.where("_rank = 1").count() == 2 and runs.where("_rank = 0").count() == 1


def test_a_hot_missing_reference(spark):
    refs = [(i, "a", "gone", t(1)) for i in range(3000)] + [(9999, "a", "x", t(1))]
    got = run(spark, refs, [("a", "x", t(0), None)])
    assert len(got) == 3000 and (9999, "missing") not in got


def test_empty_tables(spark):
    assert run(spark, [], [("a", "x", t(0), None)]) == set()
    assert run(spark, [(1, "a", "x", t(0)), (2, None, "x", t(0))], []) == {(1, "missing")}


def test_keys_are_trimmed_and_blank_ones_are_none(spark):
    df = spark.createDataFrame([(" x ",), ("\tX",), (" ",), (".",), (None,), ("",)], "k string")
    assert [r[0] for r in df.select(reference_key("k")).collect()] == ["x", "X", None, None, None, None]


IDS = ["m84_1/120/ccs", "m84_1/121/ccs", "m84_1/0121/ccs", "m84_1/12/ccs", "m84_2/120/ccs", "7", "007", "0", "-7", "x", "X", "a54c490f-f7a1-7639-74a8-3a281930f277", "a54c490f-f7a1-7639-f4a8-3a281930f278", "A54C490F-F7A1-7639-74A8-3A281930F277", "99999999999999999999999", "9" * 18, "a\nb7", "é1", "1é"]


def test_different_ids_have_different_integers(spark):
    df = spark.createDataFrame([(s, i) for s in ("a", "b") for i in IDS], "sample string, ref string")
    assert integer_keys(df, ["sample", "ref"]).select("_scope", "_hi", "_lo").distinct().count() == 2 * len(IDS)


def test_keys_are_compressed_into_runs(spark):
    df = spark.createDataFrame([("a", f"m/{i}/ccs") for i in [*range(1000, 3000), *range(3005, 3010), 70_000, 70_000]], "sample string, ref string").selectExpr("*", "timestamp'2024-01-01' born", "cast(null as timestamp) died")
    rows = parent_runs(df, ["sample", "ref"], "born", "died").where("_rank = 0").collect()
    assert {(r._lo, r._last) for r in rows} == {(1000, 2999), (3005, 3009), (70_000, 70_000)}


def test_integer_keys_and_hot_references(spark):
    rng = random.Random(5)
    parents = [(s, f"m/{i}/ccs", t(i % 40), t(i % 40 + 30) if i % 3 else None) for s in ("a", "b") for i in range(100, 400) if i % 7]
    refs = [(i, rng.choice(["a", "b"]), f"m/{rng.choice([207, 208, 210, rng.randrange(90, 420)])}/ccs", t(rng.choice([20, rng.randrange(0, 90)]))) for i in range(5000)]
    assert run(spark, refs, parents) == brute(refs, parents)


def test_only_carried_columns_come_through(spark):
    r = spark.createDataFrame([(1, "a", "x", t(1))], REF)
    got = orphan_references(r, spark.createDataFrame([], PARENT), ["sample", "ref"], "at", "born", "died", carry=["id"])
    assert [tuple(x) for x in got.collect()] == [(1, "missing")] and got.columns == ["id", "kind"]


def test_runs_reach_over_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = random.Random(8)
        parents = [("a", f"m/{i}/ccs", t(i % 40), t(i % 40 + 30) if i % 3 else None) for i in range(100, 400)]
        refs = [(i, "a", f"m/{rng.choice([207, rng.randrange(90, 420)])}/ccs", t(rng.randrange(0, 90))) for i in range(4000)]
        assert run(spark, refs, parents) == brute(refs, parents)
        # one run of keys and one of time, and references in all partitions behind them
        assert run(spark, [(i, "a", "7", t(i % 50 + 2)) for i in range(4000)], [("a", "7", t(1), None)]) == set()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
