import numpy as np
import pytest

from strandframe.operators import signal
from tests import fixtures as fx


def literal_resize(v, bins):
    e = np.linspace(0, len(v), bins + 1)
    out = []
    for i in range(bins):
        lo = int(np.floor(e[i]))
        hi = min(max(int(np.ceil(e[i + 1])), lo + 1), len(v))
        part = v[lo:hi]
        out.append(np.nan if np.isnan(part).all() else np.nanmean(part))
    return np.array(out)


@pytest.mark.parametrize(("n", "bins"), [(10, 3), (3, 10), (7, 7), (1000, 37), (1, 5)])
def test_resize(n, bins):
    v = np.random.default_rng(n).random(n)
    v[::3] = np.nan
    np.testing.assert_allclose(signal.resize(v, bins), literal_resize(v, bins), equal_nan=True)


def test_resize_of_nothing():
    assert np.isnan(signal.resize(np.array([]), 4)).all()


def test_smoothing():
    v = np.full(219, np.nan)
    v[[10, 40, 100, 180]] = [1, 0, 1, 0]
    out = signal.smooth(v)
    assert len(out) == 219 and (np.isnan(out) == np.isnan(v)).all()
    np.testing.assert_allclose(signal.smooth(np.ones(500)), 1.0)
    assert np.isnan(signal.smooth(np.full(5, np.nan))).all() and len(signal.smooth(np.array([]))) == 0
    np.testing.assert_array_equal(signal.smooth(np.array([1.0, 2.0]), 0), [1.0, 2.0])
    k = signal.gaussian(50)
    assert len(k) == 401 and k.sum() == pytest.approx(1)
    np.testing.assert_allclose(signal.convolve_same(np.array([1.0, 2, 3, 4]), np.ones(3) / 3), [5 / 3, 2, 3, 10 / 3])


def test_vectors():
    s, e = np.array([5, 8]), np.array([7, 12])
    np.testing.assert_array_equal(signal.occupancy(s, e, 4, 6), [0, 1, 1, 0, 1, 1])
    np.testing.assert_array_equal(signal.occupancy(s, e, 4, 6, (5, 9)), [np.nan, 1, 1, 0, 1, np.nan])
    p, v = np.array([4, 5, 5, 10]), np.array([1.0, 0, 1, 1])
    np.testing.assert_array_equal(signal.methylation(p, v, 4, 6), [1, 1, np.nan, np.nan, np.nan, np.nan])
    np.testing.assert_array_equal(signal.methylation(p, v, 4, 6, (5, 9)), [np.nan, 1, np.nan, np.nan, np.nan, np.nan])
    np.testing.assert_array_equal(signal.binned_methylation([np.array([1.0, np.nan, 0, 0]), np.array([0.0, 1, np.nan, np.nan])], 4, 2), [0.75, 0])


def test_body_matrices(spark):
    rows = signal.annotation_matrices(fx.regions(spark), fx.fibers(spark), fx.layers(spark), ["CGI"], min_fibers=1).collect()
    assert len(rows) == 1
    r = rows[0]
    assert len(r.nuc_body) == 1000 and len(r.nuc_meta) == 400 and r.n_fibers == 1 and r.region_id == "CGI_1"
    assert r.mean_nuc_occupancy == pytest.approx(450 / 700) and r.mean_methylation == pytest.approx(0.5)
    assert signal.annotation_matrices(fx.regions(spark), fx.fibers(spark), fx.layers(spark), ["CGI"]).count() == 0
    with pytest.raises(ValueError):
        signal.annotation_matrices(fx.regions(spark), fx.fibers(spark), fx.layers(spark), ["none"])


def test_centered_matrices(spark):
    got = signal.centered_matrices(fx.regions(spark), fx.fibers(spark), fx.layers(spark), ["Typical_Enhancer"], min_fibers=1, min_fiber_coverage=0.5).collect()
    assert [r.region_id for r in got] == ["Typical_Enhancer_2"]
    assert len(got[0].nuc) == len(got[0].met) == 5000 and len(got[0].met_binned) == 100
    assert got[0].center == 5200
    with pytest.raises(ValueError):
        signal.centered_matrices(fx.regions(spark), fx.fibers(spark), fx.layers(spark), ["CGI"], extension={})


def test_centers_and_turned_vectors(spark):
    extra = [("Promoter", "chr1", 5200, 6200, "P_1", 10), ("Promoter", "chr1", 5200, 6200, "P_2", 11)]
    strands = spark.createDataFrame([("chr1", 5200, 6200, "P_2", -1, "G")], "chrom string, start long, end long, id string, strand int, gene string")
    regions = fx.regions(spark, extra)
    c = {r.id: (r.center, r.strand, r.gene) for r in signal.region_centers(regions, strands).collect()}
    assert c["P_1"] == (5700, 0, ".") and c["P_2"] == (5700, -1, "G") and c["CGI_1"] == (500, 0, ".")
    got = {r.region_id: r for r in signal.centered_matrices(regions, fx.fibers(spark), fx.layers(spark), ["Promoter"], strands, min_fibers=1).collect()}
    assert got["P_2"].nuc == got["P_1"].nuc[::-1] and got["P_2"].nuc != got["P_1"].nuc
    plot = signal.metaplot(signal.centered_matrices(regions, fx.fibers(spark), fx.layers(spark), ["Promoter"], strands, min_fibers=1), ["annotation"], "met_binned")
    assert plot.count() == 100


def test_profiles(spark):
    got = {(r.ord, r.place): r.covered for r in signal.occupancy_profile(fx.regions(spark), fx.fibers(spark), fx.layers(spark)["nucleosomes"]).collect()}
    assert got[2, 0] == 1 and (2, 150) not in got and got[2, 549] == 1
    m = {(r.ord, r.bin): r.mean_methylation for r in signal.methylation_bins(fx.regions(spark), fx.fibers(spark), fx.layers(spark)["5mC"]).collect()}
    assert m == {(0, 0): 0.0, (0, 4): 1.0, (1, 6): 1.0, (1, 10): 0.0, (2, 1): 1.0, (2, 5): 0.0, (2, 9): 1.0, (2, 13): 0.0}


def test_calls_by_probability_where_no_call_is_stored(spark):
    from strandframe.operators.signal import is_call

    df = spark.createDataFrame([(0.4,), (0.5,), (None,)], "prob double")
    assert [r[0] for r in df.select(is_call(df)).collect()] == [False, True, None]
    bare = spark.createDataFrame([(1,)], "pos long")
    assert bare.select(is_call(bare)).first()[0] is None
