import random

import numpy as np
import pytest

from strandframe.operators import coaccess, validate
from strandframe.sources import text
from tests import fixtures as fx

BED = "chrom string, start long, end long"
COV = "el_chrom string, el_start long, el_end long, st_chrom string, st_start long, st_end long, fiber_id string, fire_score double, overlap_bp long"
PEAKS = [(100, 200), (600, 700), (2100, 2200), (3000, 3100), (5200, 5300), (6000, 6100), (7500, 7600)]


@pytest.fixture
def genome(spark, tmp_path):
    (tmp_path / "sizes").write_text("chr1\t10000\n")
    genes = [("1001", "2000", "+", "coding"), ("4001", "5000", "-", "coding"), ("7001", "8000", "+", "lncRNA")]
    (tmp_path / "g.gff").write_text("".join(f"chr1\tx\tgene\t{a}\t{b}\t.\t{s}\t.\tgene_type={k};gene_name=n\n" for a, b, s, k in genes) + "chr1\tx\texon\t1\t2\t.\t+\t.\tx=1\n#c\n")
    sizes = text.chrom_sizes(spark, tmp_path / "sizes")
    return sizes, tmp_path / "g.gff"


def test_regions(spark, genome):
    sizes, gff = genome
    genes = text.gff_genes(spark, gff, sizes)
    assert sorted((r.start, r.end) for r in genes.collect()) == [(1000, 2000), (4000, 5000)]
    kept, stitched = coaccess.prepare_regions(spark.createDataFrame([("chr1", a, b) for a, b in PEAKS], BED), genes, sizes, 500, 2500)
    assert sorted(r.start for r in kept.collect()) == [100, 2100, 3000, 6000, 7500]
    assert sorted((r.start, r.end) for r in stitched.collect()) == [(100, 200), (2100, 3100), (6000, 7600)]
    with pytest.raises(ValueError):
        coaccess.prepare_regions(kept, genes, sizes, -1)


def test_bounds_and_coordinate_modes(spark, genome):
    sizes, gff = genome
    peaks = spark.createDataFrame([("chr1", 1000, 1001), ("chrX", 1, 2), ("chr1", 9990, 10_001), ("chr1", 5, 5)], BED)
    count = lambda one_based: coaccess.intergenic_peaks(peaks, coaccess.expand_genes(text.gff_genes(spark, gff, sizes, one_based), 0), sizes).count()
    assert count(True) == 0 and count(False) == 1


def test_coverage(spark):
    pairs = spark.createDataFrame([("chr1", 120, 180, 100, 850), ("chr1", 650, 760, 100, 850)], "chrom string, es long, ee long, ss long, se long")
    got = coaccess.coverage(pairs, fx.layers(spark)["fire_accessibility"], fx.fibers(spark)).collect()
    assert sorted((r.fiber_id, r.fire_score, r.overlap_bp) for r in got) == [("fiber1", 0.05, 60), ("fiber1", 1.01, 110)]


def cov(spark, rows):
    return spark.createDataFrame(rows, COV)


def element(k, fiber, score, bp=10):
    return ("c", k * 1000, k * 1000 + 100, "c", 0, 99_000, fiber, score, bp)


def test_cells(spark):
    rows = [element(1, "a", 0.05), element(1, "a", 0.5), element(2, "a", 0.5, 60), element(2, "a", 0.4, 40), element(2, "b", 0.4, 99), element(3, None, 0.1), element(3, "a", None)]
    got = {(r.element_id, r.fiber_id): (r.best, r.bp, r.cell) for r in coaccess.cells(cov(spark, rows)).collect()}
    assert got == {("c:1000-1100", "a"): (0.05, 20, 0.05), ("c:2000-2100", "a"): (0.4, 100, 0.4), ("c:2000-2100", "b"): (0.4, 99, None)}
    objects = coaccess.object_rows(cov(spark, rows))
    assert [(e.enhId, e.fibers) for e in objects.first().enhs] == [("c:1000-1100", [0.05, None]), ("c:2000-2100", [0.4, None])]
    s = coaccess.object_summary(objects).first()
    assert (s.regions, s.elements, s.cells, s.observed, s.accessible) == (1, 2, 4, 2, 1)


def test_score_of_a_pair(spark):
    states = [(0.01, 0.02)] * 5 + [(0.01, 0.9)] * 1 + [(0.9, 0.01)] * 2 + [(0.9, 0.9)] * 3
    rows = [element(k + 1, f"f{i}", s[k], 100) for i, s in enumerate(states) for k in (0, 1)]
    pairs, clusters = coaccess.rank_pairs(cov(spark, rows), distance_correct=False)
    r = pairs.first()
    assert (r.n_both, r.n_only_b, r.n_only_a, r.n_neither, r.distance_bp, r["rank"], r.is_super) == (5, 2, 1, 3, 900, 1, True)
    assert r.score == pytest.approx(100 / 9)
    c = clusters.first()
    assert (c.stitched_id, c.elements) == ("c:0-99000", "c:1000-1100,c:2000-2100")
    assert pairs.count() == clusters.count() == 1


def test_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [element(k, f"f{i}", rng.choice([0.01, 0.05, 0.3, 0.9]), rng.choice([100, 50])) for i in range(60) for k in range(1, 7) if rng.random() < 0.6]
    got = {(r.element_a, r.element_b): (r.n_both, r.n_only_b, r.n_only_a, r.n_neither) for r in coaccess.pair_contingency(coaccess.cells(cov(spark, rows))).collect()}
    cell = {(r.element_id, r.fiber_id): r.cell for r in coaccess.cells(cov(spark, rows)).collect()}
    want = {}
    ids = [f"c:{k}000-{k}100" for k in range(1, 7)]
    for x in range(6):
        for y in range(x + 1, 6):
            n = [0, 0, 0, 0]
            for f in {f for _, f in cell}:
                a, b = cell.get((ids[x], f)), cell.get((ids[y], f))
                if a is not None and b is not None:
                    n[0 if a < 0.1 and b < 0.1 else 1 if b < 0.1 else 2 if a < 0.1 else 3] += 1
            if sum(n):
                want[ids[x], ids[y]] = tuple(n)
    assert got == want


def literal_elbow(values):
    v = sorted(max(x, 0) for x in values)
    n = len(v)
    if v[0] == v[-1]:
        return v[-1]
    slope = (v[-1] - v[0]) / n
    counts = [sum(v[j] <= slope * (j + 1) + (v[i] - slope * i) for j in range(n)) for i in range(n)]
    return v[counts.index(min(counts))]


def test_elbow():
    rng = np.random.default_rng(0)
    assert coaccess.elbow_cutoff(np.array([])) == float("inf") and coaccess.elbow_cutoff(np.array([3.0])) == 3.0 and coaccess.elbow_cutoff(np.array([2.0, 2.0])) == 2.0
    for k in range(60):
        v = rng.choice([rng.exponential(1, 40), rng.random(25), np.round(rng.lognormal(0, 2, 60), 1) - 1][k % 3], 20)
        assert coaccess.elbow_cutoff(v) == pytest.approx(literal_elbow(v.tolist()))


def test_distance_fit_and_correction(spark):
    d = np.array([100.0, 300, 1000, 3000, 10_000])
    a, b, c = coaccess.fit_power_law(d, 50 / d**0.5 + 0.2)
    assert (a, b, c) == pytest.approx((50, 0.5, 0.2), rel=1e-4) and coaccess.fit_power_law(d[:2], d[:2]) is None
    rng = np.random.default_rng(1)
    for _ in range(10):
        x = np.sort(rng.uniform(60, 50_000, 30))
        y = rng.uniform(1, 900) / x ** rng.uniform(0.2, 2) + rng.uniform(0, 2) + rng.normal(0, 0.05, 30)
        a, b, c = coaccess.fit_power_law(x, y)
        lost = lambda a, b, c: float(np.sum((a / x**b + c - y) ** 2))  # noqa: E731, B023
        # no other parameters near by, and none of many others, fit better
        tries = [(a * (1 + p), b + q, c + r) for p in (-0.01, 0, 0.01) for q in (-0.01, 0, 0.01) for r in (-0.01, 0, 0.01) if b + q > 0]
        tries += [(rng.uniform(0, 2000), rng.uniform(0.05, 3), rng.uniform(0, 3)) for _ in range(500)]
        assert lost(a, b, c) <= min(lost(*t) for t in tries) + 1e-9
    df = spark.createDataFrame([(1.0, 10), (1.0, 51), (2.0, -5)], "score double, distance_bp long")
    got = [r.corrected for r in coaccess.correct_distance(df, (1.0, 0.0, 1.0)).orderBy("distance_bp").collect()]
    assert got == [0.0, 0.0, 0.5]
    assert [r.corrected for r in coaccess.correct_distance(df, None).orderBy("distance_bp").collect()] == [2.0, 1.0, 1.0]


def test_chunks_of_pairs(spark):
    rows = [("g", f"a{k}", "b", (k * 7) % 40 + 1, float(k + 1)) for k in range(25)] + [("g", "z", "z", -3, 1.0)]
    df = spark.createDataFrame(rows, "stitched_id string, element_a string, element_b string, distance_bp long, score double")
    got = [(r.chunk, r.distance, r.score) for r in coaccess.distance_chunks(df, 10).orderBy("chunk").collect()]
    order = sorted((r for r in rows if r[3] > 0), key=lambda r: (r[3], r[1]))
    assert got == [(k, float(np.median([r[3] for r in order[10 * k : 10 * k + 10]])), float(np.median([r[4] for r in order[10 * k : 10 * k + 10]]))) for k in range(2)]


def test_canonical_pairs_and_membership(spark):
    schema = "a string, b string, score double, ord long"
    old = spark.createDataFrame([("x", "y", 1.0, 0), ("y", "x", 1.0, 1), ("x", "z", 2.0, 2), ("z", "x", 2.0 + 1e-12, 3)], schema)
    rows = validate.canonical_pairs(old, "a", "b", "score", "ord").collect()
    assert sorted((r.key_a, r.key_b, r.n_listed) for r in rows) == [("x", "y", 2), ("x", "z", 2)]
    with pytest.raises(Exception, match="disagree"):
        validate.canonical_pairs(spark.createDataFrame([("x", "y", 1.0, 0), ("y", "x", 2.0, 1)], schema), "a", "b", "score", "ord").collect()
    new = spark.createDataFrame([("x", "y"), ("q", "r")], "key_a string, key_b string")
    got = {(r.key_a, r.key_b): r.status for r in validate.membership(validate.canonical_pairs(old, "a", "b", "score", "ord"), new, ["key_a", "key_b"]).collect()}
    assert got == {("x", "y"): "shared", ("x", "z"): "left_only", ("q", "r"): "right_only"}


def test_correlations(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.random(80), 1)
    y = np.round(x + rng.random(80), 1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0)], "x double, y double")
    r = validate.correlations(df, "x", "y").first()
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert r.n == 80 and r.pearson == pytest.approx(np.corrcoef(x, y)[0, 1]) and r.spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    flat = validate.correlations(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double"), "x", "y").first()
    assert flat.pearson is None and flat.spearman is None


def test_confusion_top_k_and_fingerprints(spark):
    c = validate.confusion(spark.createDataFrame([(True, True), (True, False), (False, False)], "a boolean, b boolean"), "a", "b").first()
    assert (c.both, c.left_only, c.right_only, c.neither) == (1, 1, 0, 1) and c.agreement == pytest.approx(2 / 3)
    a = spark.createDataFrame([(f"k{i}", i + 1) for i in range(20)], "k string, rank long")
    b = spark.createDataFrame([(f"k{i}", 20 - i) for i in range(20)], "k string, rank long")
    got = {r.k: (r.used_k, r.overlap) for r in validate.top_k_overlap(a, b, ["k"], "rank", (10, 15, 50)).collect()}
    assert got == {10: (10, 0), 15: (15, 10), 50: (20, 20)}
    one, two = validate.fingerprint(a, ["k", "rank"]).first(), validate.fingerprint(a.orderBy("k").repartition(3), ["k", "rank"]).first()
    assert one == two
    lines = spark.createDataFrame([("a",), ("b",), ("b",)], "value string")
    whole, part, rest = (validate.line_fingerprint(x) for x in (lines, lines.where("value = 'a'"), lines.where("value = 'b'")))
    assert whole[0] == 3 and validate.composes(whole, part, rest) and not validate.composes(whole, part, part)
    assert validate.same_rows(lines, lines.orderBy("value")) and not validate.same_rows(lines, lines.distinct())


def test_elbow_beyond_many_near_ties():
    # 104 values close to the line of the mean slope are within three counts of the fewest, which is the last of them
    v = np.r_[np.linspace(0, 104 / 157, 104), np.linspace(104 / 157, 1, 53)]
    assert coaccess.elbow_cutoff(v) == literal_elbow(v.tolist()) > v[64]
    flat = np.r_[np.zeros(5000), np.full(5000, 0.2), 1.0]
    assert coaccess.elbow_cutoff(flat) == literal_elbow(flat.tolist())


def test_elbow_and_ranks_without_gathering(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    sets = [rng.exponential(1, 3000), np.round(rng.lognormal(0, 2, 800), 1) - 1, np.r_[np.zeros(500), np.full(500, 0.2), 1.0], np.full(40, 0.3), np.array([0.3, 0.3 + 1e-9]), np.array([2.0])]
    for k, v in enumerate(sets):
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, score double").repartition(3)
        ranked, cutoff = coaccess.rank_by(df, "score", ["i"])
        assert cutoff == pytest.approx(coaccess.elbow_cutoff(v)), k
        got = {r.i: (r["rank"], r.is_super) for r in ranked.collect()}
        order = sorted(range(len(v)), key=lambda i: (-v[i], i))
        assert got == {i: (k + 1, bool(v[i] >= cutoff)) for k, i in enumerate(order)}
    empty, cutoff = coaccess.rank_by(spark.createDataFrame([], "i long, score double").withColumn("x", F.lit(1)), "score", ["i"])
    assert empty.count() == 0 and cutoff == float("inf")
