import random

import pytest

from strandframe.operators.intervals import Overlap, contained_pairs, range_anti, range_join, stitch

F_SCHEMA = "chrom string, fs long, fe long, i long"
R_SCHEMA = "chrom string, rs long, re long, j long"
RULES = {
    Overlap.STRICT: lambda a, b, c, d: b > c and a < d,
    Overlap.INCLUSIVE: lambda a, b, c, d: b >= c and a <= d,
    Overlap.CONTAINED: lambda a, b, c, d: a >= c and b <= d,
    Overlap.CLOSED_POINT: lambda a, b, c, d: c <= a <= d,
}


def spans(rng, n):
    return [(rng.choice(["c1", "c2", None]), a := rng.randrange(-20, 300), a + rng.choice([0, 1, 5, 40, 200]), k) for k in range(n)]


@pytest.mark.parametrize("rule", list(Overlap))
@pytest.mark.parametrize("broadcast", [True, False])
def test_range_join_equals_brute_force(spark, rule, broadcast):
    rng = random.Random(5)
    f, r = spans(rng, 150), spans(rng, 60)
    got = range_join(spark.createDataFrame(f, F_SCHEMA), spark.createDataFrame(r, R_SCHEMA), ["chrom"], rule, bin_width=16, broadcast=broadcast)
    rows = [(x.i, x.j) for x in got.collect()]
    want = {(x[3], y[3]) for x in f for y in r if x[0] and x[0] == y[0] and RULES[rule](x[1], x[2], y[1], y[2])}
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_range_anti(spark, monkeypatch):
    from strandframe.operators import intervals

    rng = random.Random(6)
    f, r = spans(rng, 100), spans(rng, 15)
    want = sorted(x[3] for x in f if not any(x[0] and x[0] == y[0] and RULES[Overlap.STRICT](x[1], x[2], y[1], y[2]) for y in r))
    args = spark.createDataFrame(f, F_SCHEMA), spark.createDataFrame(r, R_SCHEMA), ["chrom"], Overlap.STRICT
    assert sorted(x.i for x in range_anti(*args).collect()) == want
    monkeypatch.setattr(intervals, "is_small", lambda *a, **k: False)
    assert sorted(x.i for x in range_anti(*args).collect()) == want


def sweep(peaks, genes, distance):
    out = []
    for chrom in {p[0] for p in peaks}:
        reach, own = None, []
        for _, s, e in sorted(p for p in peaks if p[0] == chrom):
            new = reach is None or s - reach > distance or any(g[0] == chrom and g[1] < s and g[2] > reach for g in genes)
            if new:
                own.append([s, e])
            else:
                own[-1] = [min(own[-1][0], s), max(own[-1][1], e)]
            reach = e if reach is None else max(reach, e)
        out += [(chrom, a, b) for a, b in own]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_stitching_equals_a_sweep(spark, seed):
    rng = random.Random(seed)
    peaks = [(rng.choice(["c1", "c2"]), a := rng.randrange(0, 3000), a + rng.randrange(1, 60)) for _ in range(80)]
    genes = [(rng.choice(["c1", "c2"]), a := rng.randrange(0, 3000), a + rng.randrange(1, 200)) for _ in range(12)]
    schema = "chrom string, start long, end long"
    got = stitch(spark.createDataFrame(peaks, schema), spark.createDataFrame(genes, schema), 40)
    assert sorted((r.chrom, r.start, r.end) for r in got.collect()) == sweep(peaks, genes, 40)


def test_contained_pairs(spark):
    schema = "chrom string, start long, end long"
    s = spark.createDataFrame([("chr1", 100, 800), ("chr1", 1000, 1400)], schema)
    e = spark.createDataFrame([("chr1", 120, 180), ("chr1", 200, 900), ("chr1", 300, 350), ("chr1", 650, 760), ("chr1", 900, 950)], schema)
    assert {(r.es, r.ss) for r in contained_pairs(s, e).collect()} == {(120, 100), (300, 100), (650, 100)}


def test_plans(spark):
    f = spark.createDataFrame([("c", 1, 2, 0)], F_SCHEMA)
    r = spark.createDataFrame([("c", 1, 2, 0)], R_SCHEMA)
    plan = range_join(f, r, ["chrom"], Overlap.STRICT)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
