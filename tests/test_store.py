import gzip
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandframe.config import load_config, plan_of
from strandframe.sources import export, normalize, text
from strandframe.sources.rawlines import load_raw_lines
from strandframe.sources.store import Store, build_store

NUC = "chrom,read_id,nuc_start,nuc_end,width,linker_dist\nchr1,fiber_a,100,180,80,\nchr1,fiber_a,220,300,80,40\nchr1,fiber_b,500,650,150,\nchr2,fiber_c,1000,1150,150,\n"


def modkit(*rows):
    lines = ["\t".join(f"h{i}" for i in range(15))]
    for fiber, pos, chrom, prob, code in rows:
        c = ["x"] * 15
        c[0], c[2], c[3], c[12], c[13] = fiber, str(pos), chrom, str(prob), code
        lines.append("\t".join(c))
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def inputs(tmp_path_factory):
    d = tmp_path_factory.mktemp("inputs")
    (d / "nuc.csv").write_text(NUC)
    calls = modkit(("fiber_a", 100, "chr1", 0.95, "m"), ("fiber_a", 100, "chr1", 0.10, "h"), ("fiber_a", 200, "chr1", 0.30, "m"), ("fiber_b", 50, "chr1", 0.85, "m"), ("unknown", 9, "chr1", 0.9, "m"), ("fiber_a", 9, "chrZ", 0.9, "m"), ("fiber_a", -1, "chr1", 0.9, "m"), ("fiber_a", "x", "chr1", 0.9, "m"), ("fiber_a", 210, "chr1", 0.7, "m"), ("fiber_a", 215, "chr1", 0.9, "a")) + "short\trow\n"
    with gzip.open(d / "mods.tsv.gz", "wt") as f:
        f.write(calls)
    (d / "6ma.bed").write_text("chr1\t1000\t2001\tfiber_a\t0\t+\t1000\t2001\t0\t5\t1,1,1,1,1\t0,100,200,300,1000,\nchr1\t5\n")
    (d / "msp.bed").write_text("chr1\t1000\t2001\tfiber_a\t0\t+\t1000\t2001\t0\t4\t1,50,8,1\t0,100,500,1000\n")
    (d / "fire.bed").write_text("# c\n\nchr1 110 170 fiber_a 0 + 110 170 0 0.05 H1\nchr1\t500\t760\tfiber_b\t0\t+\t500\t760\t0\t1.01\nchr1 9 5 fiber_b 0 + 9 5 0 0.1\nchr1 9 15 fiber_b 0 + 9 15 0 x\n")
    (d / "notes.bed").write_text("chr1\t90\t320\tCGI_1\nchr1\t450\t700\tCGI_2\nchr2\t950\t1200\tEnhancer_1\n")
    return d


@pytest.fixture(scope="module")
def config(inputs, tmp_path_factory):
    out = tmp_path_factory.mktemp("store")
    layers = {"nucleosomes": inputs / "nuc.csv", "5mC": inputs / "mods.tsv.gz", "5hmC": inputs / "mods.tsv.gz", "6mA": inputs / "6ma.bed", "msp": inputs / "msp.bed", "fire_accessibility": inputs / "fire.bed"}
    return plan_of(dict(output_dir=out, samples=[{"name": "d0", "layers": layers}, {"name": "d4", "layers": {"nucleosomes": inputs / "nuc.csv"}}], annotations={"master": inputs / "notes.bed"}, parameters={"methylation_threshold": 0.7}))


@pytest.fixture(scope="module")
def store(spark, config):
    return Store(spark, build_store(spark, config))


def test_text_to_queries(store):
    assert store.samples == ["d0", "d4"] and store.chromosomes("d0") == ["chr1", "chr2"]
    calls = [(r.pos, r.is_methylated) for r in store.calls("5mC", "fiber_a", "chr1", "d0").collect()]
    assert calls == [(100, True), (200, False), (210, True)]
    assert store.calls("5hmC", "fiber_a", "chr1", "d0").count() == 1
    assert [r.pos for r in store.calls("6mA", "fiber_a", "chr1", "d0").collect()] == [1100, 1200, 1300]
    assert [(r.start, r.end, r.width) for r in store.calls("msp", "fiber_a", "chr1", "d0").collect()] == [(1100, 1150, 50)]
    out = store.query_annotation("CGI", "d0", ["nucleosomes", "fire_accessibility"]).orderBy("ord").collect()
    assert [(r.fiber_id, r.n_nucleosomes, r.n_fire_accessibility, r.min_fire_score) for r in out] == [("fiber_a", 2, 1, 0.05), ("fiber_b", 1, 1, 1.01)]
    assert [r.fiber_id for r in store.fibers_at("chr1", 0, 200).collect()] == ["fiber_a"]
    assert store.fiber_chromosome("fiber_c", "d0") == "chr2" and store.fiber_chromosome("none") is None
    assert store.query_by_id("CGI_2", "d0").first().n_nucleosomes == 1
    assert store.compare_samples("CGI", ["nucleosomes"]).select("sample").distinct().count() == 2


def test_absent_layer_of_a_sample_is_null(store):
    r = store.query_annotation("CGI", "d4", ["5mC"]).first()
    assert r.n_cpg is None and r.pct_methylated is None
    assert store.calls("5mC", "fiber_a", "chr1", "d4").count() == 0
    with pytest.raises(ValueError):
        store.calls("nonsense", "fiber_a", "chr1")


def test_summary_and_metadata(store):
    s = store.summary()
    assert s["fibers"] == {"d0": 3, "d4": 3} and s["annotations"] == {"CGI": 2, "Enhancer": 1}
    assert s["metadata"]["n_fibers_d0"] == 3 and s["metadata"]["schema_version"] == "8.0"
    assert store.chromosome_data("d0", "chrX") is None
    assert set(store.chromosome_data("d0", "chr1", ["5mC"])) == {"fibers", "5mC"}
    assert {r.layer: r.records for r in store.record_counts().where("sample is null").collect()}["nucleosomes"] == 8


def test_lookups_prune_partitions(store):
    plan = store.layers["5mC"].where("sample = 'd0' and chrom = 'chr1' and fiber_int_id = 0").select("pos")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sample" in plan and "PushedFilters: [IsNotNull(fiber_int_id)" in plan and "prob" not in plan


def test_rebuild_replaces_and_errors_name_all(spark, config, inputs, tmp_path):
    alone = replace(config, store=tmp_path / "again")
    build_store(spark, alone)
    again = Store(spark, build_store(spark, alone, ["d4"]))
    assert again.samples == ["d4"] and set(again.layers) == {"nucleosomes"}
    with pytest.raises(KeyError):
        build_store(spark, alone, ["d9"])
    bad = plan_of(dict(output_dir=tmp_path, samples=[{"name": "x", "layers": {"nucleosomes": inputs / "no1", "msp": inputs / "no2"}}]))
    with pytest.raises(FileNotFoundError, match="no1.*no2"):
        build_store(spark, bad)
    with pytest.raises(FileNotFoundError):
        Store(spark, tmp_path / "nowhere")


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("output_dir: /x\nsamples:\n  - name: d0\n    layers: {nucleosomes: /n.csv}\n")
    c = load_config(p)
    assert c.store.name == "fiber_database" and list(c.layers) == ["d0"] and c.min_msp == 10 and c.threshold == 0.5
    for bad in ("output_dir: /x\nsamples: []\nextra: 1\n", "output_dir: /x\nsamples: [{name: a, layers: {msp: /m}}]\n", "output_dir: /x\nsamples: [{name: a, layers: {nucleosomes: /n, q: /m}}]\n", "output_dir: /x\nsamples: []\nparameters: {methylation_threshold: 2}\n"):
        p.write_text(bad)
        with pytest.raises(ValueError):
            load_config(p)
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none")


def test_gzip_by_content(spark, tmp_path):
    (tmp_path / "plain.gz").write_text("a\nb\n")
    with gzip.open(tmp_path / "packed.txt", "wt") as f:
        f.write("c\nd\n")
    assert [r[0] for r in text.read_lines(spark, tmp_path / "plain.gz").collect()] == ["a", "b"]
    assert [r[0] for r in text.read_lines(spark, tmp_path / "packed.txt").collect()] == ["c", "d"]
    with text.smart_open(tmp_path / "packed.txt") as f:
        assert f.read() == "c\nd\n"


def test_small_readers(spark, tmp_path):
    p = tmp_path / "f"
    p.write_text("chr1 10\nchr2\t5\nchr1 20\n")
    assert {(r.chrom, r.size) for r in text.chrom_sizes(spark, p).collect()} == {("chr1", 20), ("chr2", 5)}
    for bad in ("chr1 x\n", "chr1 0\n", ""):
        p.write_text(bad)
        with pytest.raises(Exception):
            text.chrom_sizes(spark, p).collect()
    p.write_text("#c\n\nchr2\t5\t9\nchr1\t7\t8\tn\nchr1\t7\t8\n")
    assert [tuple(r) for r in text.bed3(spark, p).collect()] == [("chr1", 7, 8), ("chr1", 7, 8), ("chr2", 5, 9)]
    for bad in ("chr1\t5\n", "chr1\ta\t9\n", "chr1\t9\t5\n"):
        p.write_text(bad)
        with pytest.raises(Exception, match="not a BED3 line"):
            text.bed3(spark, p).collect()
    p.write_text("chr1\t1\t5\tu1\t0\t-\t3\tG\nchr1\t1\t5\tu2\t0\t?\tx\n")
    assert [(r.strand, r.tss, r.gene) for r in text.strand_bed(spark, p).collect()] == [(-1, 3, "G"), (0, -1, ".")]
    p.write_text("Maximum resident set size (kbytes): 1048576\n\tElapsed: 0:01\nPercent: 5.5\nnone\n")
    assert text.parse_gnu_time(p) == {"Maximum resident set size (kbytes)": 1048576, "Elapsed": "0:01", "Percent": 5.5}
    assert text.parse_region("chr1:1,000-2,000") == ("chr1", 1000, 2000)
    with pytest.raises(ValueError):
        text.parse_region("chr1")
    assert spark.createDataFrame([("CGI_12",), ("CGI_a",), ("A_B_1",)], "i string").select(text.annotation_type(F.col("i"))).collect() == [("CGI",), ("CGI_a",), ("A_B",)]


def test_gff_dialects(spark):
    rows = spark.createDataFrame([("ID=g1;gene_type=coding;Name=a b",), ('gene_id "g2"; gene_biotype "lncRNA"; x "1"; x "2";',), ("",)], "a string")
    got = [r[0] for r in rows.select(text.gff_attributes(F.col("a"))).collect()]
    assert got[0] == {"ID": "g1", "gene_type": "coding", "Name": "a b"} and got[1] == {"gene_id": "g2", "gene_biotype": "lncRNA", "x": "2"} and got[2] == {}


def test_flatten_and_normalise(spark, tmp_path):
    p = tmp_path / "n.bed"
    p.write_text("chr1\t100\t600\tfiber_a\t0\t+\t100\t600\t0\t4\t0,80,70,0\t0,20,150,400\n")
    got = [tuple(r) for r in normalize.nucleosome_csv_rows(spark, str(p)).orderBy("nuc_start").collect()]
    assert got == [("chr1", "fiber_a", 120, 200, 80, None), ("chr1", "fiber_a", 250, 320, 70, 50)]
    p.write_text("chr1\t100\t600\tfiber_a\t0\t+\t100\t600\t0\t4\t0,80,70\t0,20,150,400\n")
    with pytest.raises(Exception, match="list_lengths_differ"):
        normalize.nucleosome_csv_rows(spark, str(p)).collect()
    p.write_text("chr1\t0\t50\tf\t0\t+\t0\t50\t0\t3\t1,1,1\t0,20,49\nchr1\t0\t50\tf\t0\t+\t0\t50\t0\t1,1,1,\t0,20,49\nchr1\t0\t50\tf\t0\t+\t0\t50\t1,4,1\t0,20,40\nbad\n")
    loaded = load_raw_lines(normalize.raw_file(spark, str(p), "block_bed"))
    assert [(r.block_count, r.sizes) for r in normalize.normalized_block_bed(loaded).orderBy("sizes").collect()] == [(3, "1,1,1"), (3, "1,1,1"), (3, "1,4,1")]
    assert normalize.block_bed_report(loaded).first().asDict() == {"records": 4, "valid": 3, "invalid": 1, "blocks": 9, "inner_blocks": 3, "inner_single_base": 2}
    with pytest.raises(Exception, match="not single bases"):
        normalize.normalized_block_bed(loaded, "single_base").collect()


def test_all_to_modkit(spark, tmp_path):
    p = tmp_path / "a.tsv"
    names = list(normalize.ALL_REQUIRED)
    row = {"ct": "chr1", "st": "1", "en": "9", "fiber": "f", "strand": "+", "ref_msp_starts": ".", "ref_msp_lengths": ".", "fire": ".", "ref_m6a": "5", "m6a_qual": "9", "ref_5mC": "107,-1,112", "5mC_qual": "255,200,128"}
    p.write_text("#" + "\t".join(names) + "\n" + "\t".join(row[c] for c in names) + "\n")
    loaded = load_raw_lines(normalize.raw_file(spark, str(p), "all_tsv"))
    assert [tuple(r) for r in normalize.all_to_modkit(loaded).collect()] == [("f", 107, "chr1", "1.000000", "m"), ("f", 112, "chr1", "0.501961", "m")]
    assert normalize.inspect_all(str(p), loaded) == {"records": 1, "m5c_calls": 2, "m6a_calls": 1, "msp": 0, "fire_scores": 0}
    p.write_text("#ct\tst\n")
    with pytest.raises(ValueError, match="lacks"):
        normalize.inspect_all(str(p), loaded)


def test_sam_rules(spark):
    lines = spark.createDataFrame([("@HD\tVN:1.6\tSO:coordinate",), ("@SQ\tSN:chr1\tLN:5",), ("r\t0\tchr1\t1\t60\t1M\t*\t0\t0\tA\tI\tMM:Z:C+m,0;\tML:B:C,9",)], "value string")
    assert normalize.check_sam(lines) == {"coordinate_sorted": True, "chr_contigs": True, "mm_tags": True, "ml_tags": True}
    assert not any(normalize.check_sam(lines.limit(0)).values())


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("chr2", 1, 2), ("chr1", 5, 6)], "chrom string, start long, end long")
    assert export.write_bed3(df, tmp_path / "x.bed") == 2 and (tmp_path / "x.bed").read_text() == "chr1\t5\t6\nchr2\t1\t2\n"
    assert export.format_score(1.01) == "1.01" and export.format_score(0.1234567891234) == "0.123456789" and export.format_score(5.0) == "5"
    assert export.provenance(tmp_path / "x.bed")["size_bytes"] == 18
    assert json.loads(export.write_manifest(tmp_path / "m", {"a": 1}).read_text())["a"] == 1
    assert export.folder_inventory(tmp_path / "m").keys() == {"manifest.json"}
