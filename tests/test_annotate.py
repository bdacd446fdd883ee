import pytest
from pyspark.sql import functions as F

from strandframe.operators import access, annotate, features, tracks
from strandframe.operators.intervals import Overlap
from tests import fixtures as fx


def one(df, **where):
    rows = [r for r in df.collect() if all(r[k] == v for k, v in where.items())]
    assert len(rows) == 1, rows
    return rows[0]


def test_methylation_of_a_region(spark):
    out = annotate.query_annotation(fx.regions(spark), fx.fibers(spark), fx.layers(spark), "CGI", "d0", ["5mC"])
    r = one(out)
    assert (r.fiber_id, r.n_cpg, r.pct_methylated, r.region_id) == ("fiber1", 4, 50.0, "chr1:150-850")


def test_containment_and_means(spark):
    out = annotate.query_annotation(fx.regions(spark), fx.fibers(spark), fx.layers(spark), "Typical_Enhancer", "d0", ["nucleosomes", "msp"])
    r = one(out, fiber_id="fiber1")
    assert (r.n_nucleosomes, r.mean_nuc_width, r.mean_linker, r.mean_repeat_length, r.n_msp, r.mean_msp_width) == (1, 150, 50, 200, 0, None)
    r = one(out, fiber_id="fiber2")
    assert (r.n_nucleosomes, r.mean_linker, r.n_msp) == (2, 50, 1)


def test_fire_overlaps_inclusively(spark):
    r = one(annotate.query_annotation(fx.regions(spark), fx.fibers(spark), fx.layers(spark), "CGI", "d0", ["fire_accessibility"]))
    assert (r.n_fire_accessibility, r.min_fire_score, r.fire_overlap_bp) == (2, 0.05, 140)
    assert r.mean_fire_score == pytest.approx(0.53)


def test_absent_layers_are_null_or_zero(spark):
    layers = fx.layers(spark)
    layers["5hmC"] = layers["5mC"].where("false")
    out = annotate.query_annotation(fx.regions(spark), fx.fibers(spark), layers, "CGI", "d0", ["5hmC", "nonsense"])
    assert one(out).n_5hmC is None
    by_id = annotate.query_by_id(fx.regions(spark), fx.fibers(spark), layers, "CGI_1", "d0")
    r = one(by_id)
    assert (r.region_id, r.n_nucleosomes, r.n_cpg) == ("CGI_1", 3, 4)
    assert "mean_linker" not in by_id.columns and "fire_overlap_bp" not in by_id.columns


def test_repeated_regions_have_rows_of_their_own(spark):
    extra = [("CGI", "chr1", 150, 850, "CGI_2", 3)]
    out = annotate.query_annotation(fx.regions(spark, extra), fx.fibers(spark), fx.layers(spark), "CGI", "d0", ["nucleosomes"])
    assert out.count() == 2 and out.select("region_id").distinct().count() == 1


def test_first_regions_and_unknown_names(spark):
    q = lambda *a: annotate.query_annotation(fx.regions(spark), fx.fibers(spark), fx.layers(spark), *a).count()
    assert q("Typical_Enhancer", "d0", ["nucleosomes"], 1) == 1
    assert q("Typical_Enhancer", "d0", ["nucleosomes"], 0) == 2
    assert q("none", "d0") == 0 and q("CGI", "none") == 0


def test_monster_and_reversed_fibers_are_left_out(spark):
    extra = [("d0", "chr1", 2, "monster", 500, 500_000_000), ("d0", "chr1", 3, "back", 1800, 900)]
    f = fx.fibers(spark, extra)
    assert [r.fiber_id for r in access.fibers_at(f, "chr1", 1000, 2000).collect()] == ["fiber1"]


def test_lookup_is_half_open(spark):
    f = fx.fibers(spark)
    ids = lambda a, b: {r.fiber_id for r in access.fibers_at(f, "chr1", a, b).collect()}
    assert ids(2100, 3000) == set() and ids(2099, 3000) == {"fiber1"} and ids(50, 100) == set() and ids(500, 500) == set() and ids(600, 500) == set()
    r = spark.createDataFrame([("chr1", 2100, 3000, 0)], "chrom string, start long, end long, ord long")
    assert access.overlapping_fibers(f, r).count() == 1 and access.overlapping_fibers(f, r, Overlap.STRICT).count() == 0


def test_spanning_fibers(spark):
    r = spark.createDataFrame([("chr1", 500, 1500, 0), ("chr1", 0, 200, 1), ("chr1", 300, 300, 2)], "chrom string, start long, end long, ord long")
    got = access.spanning_fibers(fx.fibers(spark), r).collect()
    assert [(x.ord, x.fiber_int_id) for x in got] == [(0, 0)]


def test_ids_slices_and_names(spark):
    layers, f = fx.layers(spark), fx.fibers(spark)
    assert {(r.fiber_int_id, r.start_row, r.end_row) for r in access.layer_slices(layers["nucleosomes"]).collect()} == {(0, 0, 3), (1, 3, 5)}
    assert [r.start for r in access.calls_of_fiber(layers["nucleosomes"], f, "fiber1", "chr1", "d0").collect()] == [150, 350, 550]
    assert access.calls_of_fiber(layers["msp"], f, "none", "chr1", "d0").count() == 0
    named = access.annotation_regions(fx.regions(spark).withColumn("id", F.lit(None).cast("string")), "Typical_Enhancer").collect()
    assert [r.id for r in named] == ["Typical_Enhancer_0", "Typical_Enhancer_1"]
    assert access.annotation_by_id(fx.regions(spark), "CGI_1").first().start == 150
    assert access.annotation_by_id(fx.regions(spark), "CGI_9").count() == 0
    ids = access.fiber_int_ids(spark.createDataFrame([("a", "c", "z"), ("a", "c", "B"), ("a", "c", "a"), ("a", "c", "z")], "sample string, chrom string, fiber_id string"))
    assert {(r.fiber_id, r.fiber_int_id) for r in ids.collect()} == {("B", 0), ("a", 1), ("z", 2)}


def test_feature_fractions(spark):
    r = one(features.fiber_fractions(fx.fibers(spark), fx.layers(spark)), fiber_id="fiber1")
    assert r.frac_nuc_coverage == pytest.approx(450 / 2000) and r.frac_msp_coverage == pytest.approx(250 / 2000)
    assert (r.n_5mC, r.frac_5mC_among_cpg, r.n_5hmC, r.frac_5hmC_among_cpg, r.frac_6mA_among_A) == (4, 0.5, 0, None, 0.0)
    assert features.fiber_fractions(fx.fibers(spark), fx.layers(spark), 1).count() == 1


def test_record_counts(spark):
    got = {r.layer: r.records for r in features.record_counts(fx.fibers(spark), fx.layers(spark), fx.regions(spark)).where("sample is null").collect()}
    assert got == {"fibers": 2, "5mC": 6, "5hmC": 0, "6mA": 0, "msp": 3, "nucleosomes": 5, "fire_accessibility": 3, "annotations": 3}


def test_ecdf_and_statistics(spark):
    rows = spark.createDataFrame([("a", 0.03), ("a", 0.01), ("a", 0.2), ("a", 0.01), ("a", None), ("a", float("nan"))], "k string, v double")
    pts = sorted((r.x, r.y) for r in features.ecdf(rows, ["k"], "v").collect())
    assert pts == [(0.0, 0.0), (0.01, 0.25), (0.01, 0.5), (0.03, 0.75), (0.2, 1.0), (1.0, 1.0)]
    s = features.summary_statistics(spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)], "k string, v double"), ["k"], "v").first()
    assert (s.median, s.q25, s.q75, s.n) == (2.5, 1.75, 3.25, 4)


def test_tracks_are_clipped(spark):
    rows = tracks.single_molecule_rows(fx.fibers(spark), fx.layers(spark), "chr1", 200, 600, tracks=("nucleosomes", "5mC", "6mA"))
    got = {(r.track, r.left, r.right) for r in rows.collect()}
    assert got == {("fiber", 200, 600), ("nucleosomes", 200, 300), ("nucleosomes", 350, 500), ("nucleosomes", 550, 600), ("5mC", 200, 201), ("5mC", 400, 401)}
