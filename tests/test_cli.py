import json

import pytest

from strandframe import cli
from strandframe.sources.text import COV_COLUMNS
from strandframe.streaming.ingest import ingest, raw_line_stream, windowed_counts
from tests.test_rawlines import BED12


def test_build_query_and_rank(spark, tmp_path, capsys):
    (tmp_path / "nuc.csv").write_text("chrom,read_id,nuc_start,nuc_end,width\nchr1,f1,100,180,80\nchr1,f2,500,650,150\n")
    (tmp_path / "fire.bed").write_text("".join(f"chr1\t{s}\t{s + 60}\t{f}\t0\t+\t0\t0\t0\t0.05\tH1\n" for f in ("f1", "f2") for s in (110, 510)))
    (tmp_path / "notes.bed").write_text("chr1\t90\t320\tCGI_1\n")
    (tmp_path / "c.yaml").write_text(f"output_dir: {tmp_path}\nsamples:\n  - name: d0\n    layers: {{nucleosomes: {tmp_path}/nuc.csv, fire_accessibility: {tmp_path}/fire.bed}}\nannotations: {{master: {tmp_path}/notes.bed}}\n")
    store = str(tmp_path / "fiber_database")
    assert cli.main(["build", "--config", str(tmp_path / "c.yaml")]) == 0
    assert cli.main(["info", store]) == 0
    assert json.loads(capsys.readouterr().out.split("fiber_database\n")[-1])["fibers"] == {"d0": 2}
    assert cli.main(["query", store, "chr1:0-200"]) == 0 and capsys.readouterr().out.strip() == "1"
    assert cli.main(["query", store, "chr1:0-700", "--out", str(tmp_path / "ids")]) == 0 and (tmp_path / "ids").read_text() == "f1\nf2\n"
    assert cli.main(["annotate", store, "CGI", str(tmp_path / "a.csv"), "--layer", "nucleosomes"]) == 0 and len((tmp_path / "a.csv").read_text().splitlines()) == 2
    assert cli.main(["features", store, str(tmp_path / "f.csv")]) == 0 and len((tmp_path / "f.csv").read_text().splitlines()) == 3
    (tmp_path / "peaks").write_text("chr1\t100\t200\nchr1\t500\t600\n")
    (tmp_path / "sizes").write_text("chr1\t10000\n")
    (tmp_path / "genes").write_text("chr1\tx\tgene\t8001\t9000\t.\t+\t.\tgene_type=coding\n")
    run = ["coaccess", "prepare", "--peaks", str(tmp_path / "peaks"), "--genes", str(tmp_path / "genes"), "--sizes", str(tmp_path / "sizes"), "--outdir", str(tmp_path / "o")]
    assert cli.main(run) == 0 and (tmp_path / "o/stitched_regions.bed").read_text() == "chr1\t100\t600\n"
    cov = ["coaccess", "cov", "--store", store, "--stitched", str(tmp_path / "o/stitched_regions.bed"), "--peaks", str(tmp_path / "peaks"), "--out", str(tmp_path / "cov.bed")]
    assert cli.main(cov) == 0 and (tmp_path / "cov.bed").read_text().splitlines()[0].split("\t") == ["chr1", "100", "200", "chr1", "100", "600", "f1", "0.05", "60"]
    assert cli.main(["coaccess", "object", "--cov", str(tmp_path / "cov.bed"), "--out", str(tmp_path / "obj.json")]) == 0
    assert json.loads((tmp_path / "obj.json").read_text())[0]["seId"] == "chr1:100-600"
    assert cli.main(["coaccess", "rank", "--cov", str(tmp_path / "cov.bed"), "--outdir", str(tmp_path / "r")]) == 0 and (tmp_path / "r/pairs.tsv").read_text() == ""
    assert len(COV_COLUMNS) == 9


def test_errors(spark, tmp_path, capsys):
    assert cli.main(["info", str(tmp_path / "none")]) == 1 and "no store" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        cli.main([])


def test_stream_of_raw_lines(spark, tmp_path):
    rows = [(i, "block_bed", "f", i, BED12 if i % 3 else "broken\tline", None) for i in range(1, 31)]
    spark.createDataFrame(rows, "rec_id long, fmt string, file_name string, line_no long, line string, loaded_at timestamp").write.parquet(str(tmp_path / "in"))
    q = ingest(raw_line_stream(spark, str(tmp_path / "in")), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "ok")).count() == 20 and spark.read.parquet(str(tmp_path / "bad")).count() == 10
    assert windowed_counts(raw_line_stream(spark, str(tmp_path / "in")), "loaded_at", ["fmt"]).isStreaming


def test_validation_of_two_rankings(spark, tmp_path):
    import json

    head = "a\tb\ts\tscore\trank\tclass\n"
    # the earlier run lists each pair both ways
    (tmp_path / "op").write_text(head + "x\ty\tr1\t5\t1\tSuper\ny\tx\tr1\t5\t1\tSuper\nu\tv\tr2\t1\t2\t\nv\tu\tr2\t1\t2\t\n")
    (tmp_path / "np").write_text(head + "y\tx\tr1\t4\t1\tSuper\nu\tv\tr2\t2\t2\tSuper\np\tq\tr3\t1\t3\t\n")
    head = "s\tscore\trank\tclass\telements\tpair\ta\tb\tc\td\n"
    (tmp_path / "oc").write_text(head + "r1\t5\t1\tSuper\nr2\t1\t2\t\n")
    (tmp_path / "nc").write_text(head + "r1\t4\t1\tSuper\tx\tx\t3\t1\t1\t0\nr2\t2\t2\t\tx\tx\t3\t1\t1\t0\nr3\t1\t3\t\tx\tx\t1\t1\t1\t0\n")
    (tmp_path / "ov").write_text("l1\nl2\nl3\n")
    (tmp_path / "nv").write_text("l3\nl1\n")
    (tmp_path / "dv").write_text("l2\n")
    names = {"old-pairs": "op", "new-pairs": "np", "old-clusters": "oc", "new-clusters": "nc", "old-cov": "ov", "new-cov": "nv", "cov-difference": "dv", "outdir": "out"}
    assert cli.main(["coaccess", "validate", *[x for k, v in names.items() for x in (f"--{k}", str(tmp_path / v))]]) == 0
    got = json.loads((tmp_path / "out" / "validation_summary.json").read_text())
    p = got["pairs"]
    assert (p["left_listed"], p["left_rows"], p["right_rows"], p["shared"], p["right_only"]) == (4, 2, 3, 2, 1) and p["score_pearson"] == 1 and p["super_both"] == 1 and p["super_right_only"] == 1
    assert got["clusters"]["right_only"] == 1 and got["clusters"]["right_only_half_jaccard"] == 1
    assert not got["coverage"]["equal"] and got["coverage"]["right_and_difference_are_left"] and got["top_k"][0]["overlap"] == 2
    assert (tmp_path / "out" / "pair_membership.tsv").exists()


def test_flags_hold_before_the_file(spark, tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text(f"output_dir: {tmp_path}\nsamples:\n  - name: d0\n    layers: {{nucleosomes: /n.csv}}\nparameters: {{min_msp_size: 4}}\n")
    seen = []
    monkeypatch.setattr(cli, "build_store", lambda spark, plan, samples: seen.append(plan))
    assert cli.main(["build", "--config", str(tmp_path / "c.yaml"), "--output", "/elsewhere", "--methylation-threshold", "0.8"]) == 0
    assert str(seen[0].store) == "/elsewhere" and seen[0].threshold == 0.8 and seen[0].min_msp == 4
