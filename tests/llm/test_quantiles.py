import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm.quantiles import RANK_ERROR, SPARSE_CODES, Sketch, build_sketches, decode, encode, merge_sketches, quantiles

SHARES = [0.0, 0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


def rank_error(values, got):
    v, worst = np.sort(values), 0.0
    for q, x in zip(SHARES, got):
        lo, hi = np.searchsorted(v, x - abs(x) * 2e-6), np.searchsorted(v, x + abs(x) * 2e-6, "right")
        worst = max(worst, lo - q * len(v), q * len(v) - hi)
    return worst / len(v)


def draw(kind, n, seed=0):
    r = np.random.default_rng(seed)
    return {"uniform": r.random(n), "zeros": np.where(r.random(n) < 0.4, 0.0, r.lognormal(-4, 2, n)), "ties": np.round(r.random(n), 2), "signed": r.normal(0, 9, n), "one": np.full(n, 3.5)}[kind]


def test_codes_keep_order():
    v = np.array([-np.inf, -1e300, -2.5, -1e-300, 0.0, 1e-300, 0.5, 2.5, 1e300, np.inf])
    c = encode(v)
    assert (np.diff(c) > 0).all() and encode(np.array([-0.0]))[0] == c[4]
    assert np.allclose([decode(int(x)) for x in c[1:-1]], v[1:-1], rtol=1e-6, atol=0) and decode(int(c[4])) == 0.0


@pytest.mark.parametrize("kind", ["uniform", "zeros", "ties", "signed", "one"])
@pytest.mark.parametrize("n", [1, 100, 60_000])
def test_ranks_stay_within_the_bound(kind, n):
    v = draw(kind, n)
    s = Sketch()
    for part in np.array_split(v, 7):
        s.add(encode(part), np.ones(len(part), np.int64))
    count, got = s.quantiles(SHARES)
    assert count == n and rank_error(v, got) <= RANK_ERROR + 1 / n


def merged(parts):
    out = Sketch()
    for p in parts:
        for level, row, codes, weights in p.rows():
            w = np.frombuffer(weights, np.int64)
            if level < 0:
                out.add(np.frombuffer(codes, np.int64), w)
            else:
                out.add_row(level, row, w)
    return out


def sketch_of(v, weight=1):
    s = Sketch()
    s.add(encode(v), np.full(len(v), weight, np.int64))
    s.settle()
    return s


def test_merging_is_addition_in_any_order():
    v = draw("uniform", 40_000)
    days = np.split(v, [10, 3000, 20_000])
    whole = sketch_of(v)
    a, b = merged([sketch_of(d) for d in days]), merged([sketch_of(d) for d in reversed(days)])
    for s in (a, b):
        s.settle()
        assert (s.cells == whole.cells).all() and (s.tops == whole.tops).all()


def test_rows_are_deleted_by_their_weight():
    v, gone = draw("uniform", 30_000), draw("signed", 20_000, 1)
    s = merged([sketch_of(np.r_[v, gone]), sketch_of(gone, -1)])
    n, got = s.quantiles(SHARES)
    assert n == len(v) and rank_error(v, got) <= RANK_ERROR
    assert merged([sketch_of(v[:50]), sketch_of(v[:50], -1)]).quantiles([0.5]) == (0, [None])


@pytest.mark.parametrize("kind", ["uniform", "zeros", "signed"])
@pytest.mark.parametrize("n", [7, 1000, SPARSE_CODES])
def test_states_kept_as_lists_answer_as_counters_do(kind, n):
    v = draw(kind, n)
    sparse, dense = sketch_of(v), Sketch()
    dense._densify()
    dense.add(encode(v), np.ones(n, np.int64))
    assert sparse.cells is None and sparse.quantiles(SHARES) == dense.quantiles(SHARES)
    assert rank_error(v, sparse.quantiles(SHARES)[1]) <= RANK_ERROR + 1 / n


@pytest.mark.parametrize("kind", ["uniform", "zeros", "signed"])
def test_ranks_of_a_million_values_stay_within_the_bound(kind):
    v = draw(kind, 1_000_000, 3)
    s = merged([sketch_of(p) for p in np.array_split(v, 9)])
    assert rank_error(v, s.quantiles(SHARES)[1]) <= RANK_ERROR


def test_in_spark_days_combine(spark):
    rows = [(k % 3 == 0 and "a" or (k % 3 == 1 and "b" or None), k % 20, float(v)) for k, v in enumerate(draw("zeros", 30_000))]
    rows += [("a", 1, float("nan")), ("a", 1, None), ("void", 1, None)]
    df = spark.createDataFrame(rows, "sample string, day int, v double").withColumn("extra", F.lit("x")).repartition(4)
    days = build_sketches(df, ["sample", "day"], "v")
    out = quantiles(merge_sketches(days, ["sample"]), ["sample"], SHARES).collect()
    for s in ("a", "b", None):
        own = [r[2] for r in rows if r[0] == s and r[2] is not None and r[2] == r[2]]
        got = {r.share: (r.value, r.n) for r in out if r.sample == s}
        assert {n for _, n in got.values()} == {len(own)}
        assert rank_error(np.array(own), [got[q][0] for q in SHARES]) <= RANK_ERROR
    assert len(out) == 3 * len(SHARES)
    one_day = quantiles(merge_sketches(days.where("day = 3"), ["sample", "day"]), ["sample", "day"], [0.5]).collect()
    assert len(one_day) == 3


def test_empty_table_and_wrong_shares(spark):
    df = spark.createDataFrame([], "k string, v double")
    assert quantiles(merge_sketches(build_sketches(df, ["k"], "v"), ["k"]), ["k"], [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles(build_sketches(df, ["k"], "v"), ["k"], [1.5])
    with pytest.raises(ValueError):
        build_sketches(df.withColumnRenamed("k", "level"), ["level"], "v")
