import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators.periods import merged_periods

SCHEMA = "sample string, chrom string, f long, a long, b long"


def brute(rows):
    by = {}
    for s, c, f, a, b in rows:
        if None not in (s, c, f, a, b) and b > a:
            by.setdefault((s, c, f), []).append((a, b))
    out = set()
    for key, spans in by.items():
        merged = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {("period", *key, a, b) for a, b in merged}
        out |= {("gap", *key, x[1], y[0]) for x, y in zip(merged, merged[1:])}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("starts", F.lit("clash")).withColumn("bucket", F.lit(1)).repartition(3)
    got = [tuple(r) for r in merged_periods(df, ["sample", "chrom", "f"], "a", "b", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("width", [16, 64, 1 << 17])
def test_random_spans_equal_a_sweep(spark, width):
    rng = random.Random(width)
    rows = []
    for _ in range(3000):
        a = rng.choice([rng.randrange(-50, 400), rng.randrange(0, 4000)])
        b = a + rng.choice([-3, 0, 1, 5, 20, 300])
        rows.append((rng.choice(["x", "y", None]), rng.choice(["c1", "c2"]), rng.choice([1, 2, 3, 4, None, 10**12]), rng.choice([a] * 20 + [None]), rng.choice([b] * 20 + [None])))
    assert run(spark, rows, bucket_width=width) == brute(rows)


def test_a_hot_fiber_over_many_buckets(spark):
    rng = random.Random(1)
    rows = [("x", "c", 1, a := rng.randrange(0, 50_000), a + rng.randrange(1, 30)) for _ in range(6000)] + [("x", "c", 1, 100, 40_000)] + [("x", "c", k, 5, 9) for k in range(50)]
    assert run(spark, rows, bucket_width=512) == brute(rows)


def test_touching_nested_and_repeated_spans(spark):
    rows = [("x", "c", 1, 0, 10), ("x", "c", 1, 10, 20), ("x", "c", 1, 2, 5), ("x", "c", 1, 0, 10), ("x", "c", 1, 25, 30)]
    assert run(spark, rows) == {("period", "x", "c", 1, 0, 20), ("gap", "x", "c", 1, 20, 25), ("period", "x", "c", 1, 25, 30)}


def test_empty_and_unusable_tables(spark):
    assert run(spark, []) == set()
    assert run(spark, [("x", "c", 1, 5, 5), ("x", "c", 1, 7, 2), (None, "c", 1, 1, 2), ("x", "c", 1, None, 3)]) == set()
