import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandframe.sources import rawlines
from strandframe.sources.rawlines import _Broken, clean_stretches, load_raw_lines, read_header, split_fields, strict_all, strict_block_bed

SCHEMA = "rec_id long, fmt string, file_name string, line_no long, line string"
BED12 = "chr1\t100\t1101\tf1\t0\t+\t100\t1101\t0\t4\t1,50,8,1\t0,100,500,1000"
HEADER = "#ct\tst\ten\tfiber\tstrand\tref_nuc_starts\tref_nuc_lengths\tref_msp_starts\tref_msp_lengths\tfire\tref_m6a\tm6a_qual\tref_5mC\t5mC_qual"
ALL = "chr1\t10\t90\tf1\t+\t10,30\t5,5\t20,40,\t9,9,\t0.5,.,\t11,-1,13\t255,.,3\t12\t0"

BAD_BED = {
    "column_count": ["chr1\t1\t2", BED12 + "\tx"],
    "not_an_integer:start": [BED12.replace("\t100\t1101\tf1", "\t1e2\t1101\tf1"), BED12.replace("\t100\t1101\tf1", "\t+100\t1101\tf1"), BED12.replace("\t100\t1101\tf1", "\t 100\t1101\tf1")],
    "start_after_end": [BED12.replace("\t100\t1101\tf1", "\t2000\t1101\tf1")],
    "thick_start_after_end": [BED12.replace("+\t100\t1101", "+\t1102\t1101")],
    "strand": [BED12.replace("+", "*")],
    "not_an_integer:sizes": [BED12.replace("1,50,8,1", "1,,8,1"), BED12.replace("1,50,8,1", ""), BED12.replace("1,50,8,1", "1,50,8,1,,"), BED12.replace("1,50,8,1", "1;50;8;1")],
    "list_lengths_differ:sizes,starts": [BED12.replace("1,50,8,1", "1,50,8")],
    "negative_entry": [BED12.replace("1,50,8,1", "1,-50,8,1")],
    "start_beyond_record": [BED12.replace("500,1000", "500,1002")],
    "block_count": [BED12.replace("\t4\t1,50", "\t5\t1,50")],
    "unclosed_quote": [BED12.replace("f1", '"f1')],
    "text_after_quote": [BED12.replace("f1", '"f1"x')],
}
GOOD_BED = [
    BED12, BED12 + "\r", BED12.replace("1,50,8,1", "1,50,8,1,"), BED12.replace("f1", '"f\t""1"""'), BED12.replace("f1", 'f"1"'), BED12.replace("500,1000", "500,1001"),
    "chr1\t100\t1101\tf1\t0\t.\t-5\t7\t9,9,9\t1,50\t0,100", "chr1\t1\t1\tf1\t0\t-\t1\t1\t0\t0",
]
BAD_ALL = {
    "column_count": [ALL + "\tx"],
    "empty:ct": [ALL.removeprefix("chr1")],
    "not_an_integer:en": [ALL.replace("\t90\t", "\t9x\t")],
    "not_an_integer:ref_nuc_starts": [ALL.replace("10,30", "10,3%")],
    "not_a_number:fire": [ALL.replace("0.5,.", "0.5,high"), ALL.replace("0.5,.", "0.5,0x1f"), ALL.replace("0.5,.", "0.5,1e")],
    "list_lengths_differ:ref_msp_starts,ref_msp_lengths,fire": [ALL.replace("0.5,.,", "0.5,"), ALL.replace("0.5,.,", "0.5,.,,")],
    "quality_range:m6a_qual": [ALL.replace("255,.,3", "256,.,3"), ALL.replace("255,.,3", ".,.,3"), ALL.replace("255,.,3", "-1,.,3")],
}


def rows_of(lines, fmt="block_bed", name="x.bed", first=1):
    return [(first + i, fmt, name, first + i, line) for i, line in enumerate(lines)]


def load(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("reason", F.lit("clash")).withColumn("header", F.lit(3))
    return {r.rec_id: r for r in load_raw_lines(df).collect()}


def test_fields_and_quotes():
    assert split_fields('a\t"b\tc"\t"d""e"\tf"g\t') == ["a", "b\tc", 'd"e', 'f"g', ""]
    assert split_fields('""\t"x"') == ["", "x"]
    for bad in ('"a', 'x\t"a"b', '"a""'):
        with pytest.raises(_Broken):
            split_fields(bad)


@pytest.mark.parametrize("many", [False, True])
def test_block_bed_reasons(spark, many):
    """Each broken line with its reason, alone in strict parsing and among many good ones in bulk parsing."""
    bad = [(line, why) for why, lines in BAD_BED.items() for line in lines]
    lines = [line for line, _ in bad] + GOOD_BED + [BED12] * (3000 if many else 0)
    rng = random.Random(0)
    order = list(range(len(lines)))
    rng.shuffle(order)
    got = load(spark, [(i, "block_bed", "x.bed", k + 1, lines[i]) for k, i in enumerate(order)])
    assert len(got) == len(lines)
    for i, (line, why) in enumerate(bad):
        assert got[i].reason == why, line
    for i in range(len(bad), len(lines)):
        assert got[i].reason is None, lines[i]
    first = got[len(bad)]
    assert (first.chrom, first.start, first.sizes, first.starts) == ("chr1", 100, [1, 50, 8, 1], [0, 100, 500, 1000])


@pytest.mark.parametrize("head", [HEADER, HEADER + "\r", HEADER.removeprefix("#")])
def test_all_reasons(spark, head):
    bad = [(line, why) for why, lines in BAD_ALL.items() for line in lines]
    good = [ALL, ALL + "\r", ALL.replace("11,-1,13", "11,.,13"), ALL.replace("\tf1\t", '\t"f1"\t'), ALL.replace("10,30\t5,5", "\t")]
    got = load(spark, rows_of([head, *[x for x, _ in bad], *good, *[ALL] * 500], "all_tsv", "x.tsv"))
    assert 1 not in got
    for i, (line, why) in enumerate(bad):
        assert got[i + 2].reason == why, line
    assert all(got[i].reason is None for i in range(len(bad) + 2, len(got) + 2))
    r = got[len(bad) + 2]
    assert r.m6a_qual == [255, None, 3] and r.fire == [0.5, None] and r.ref_msp_starts == [20, 40]


def test_column_order_differs_by_file(spark):
    names = HEADER.removeprefix("#").split("\t")
    turned = "\t".join(reversed(names))
    line = "\t".join(reversed(ALL.split("\t")))
    got = load(spark, rows_of([HEADER, ALL], "all_tsv", "a") + rows_of([turned, line, ALL], "all_tsv", "b", 1)[1:2] + [(50, "all_tsv", "b", 1, turned)] + [(51, "all_tsv", "b", 3, line)])
    assert got[51].reason is None and got[51].name == "f1"


def test_no_records_and_odd_lines(spark):
    rows = rows_of(["", "  ", "\r", "#x", "# resumed\r", None, BED12]) + [(90, "other", "x", 1, "a"), (91, "all_tsv", "headless", 2, ALL), (92, None, None, None, BED12)]
    got = load(spark, rows)
    assert {k: v.reason for k, v in got.items()} == {7: None, 90: "unknown_format", 91: "no_header", 92: "unknown_format"}
    assert load(spark, []) == {}


def test_a_very_long_line_and_a_huge_integer(spark):
    n = 60_000
    line = f"chr1\t0\t{n}\tf\t0\t+\t0\t{n}\t" + ",".join(["1"] * n) + "\t" + ",".join(map(str, range(n)))
    got = load(spark, rows_of([line, BED12.replace("\t1101\tf1", "\t99999999999999999999\tf1")] + [BED12] * 20))
    assert len(got[1].sizes) == n and got[2].reason == "integer_out_of_range:end"


def test_bulk_equals_strict_on_mutated_lines(spark):
    rng = random.Random(7)
    lines = []
    for _ in range(2500):
        line = list(rng.choice([BED12, GOOD_BED[6], GOOD_BED[7]]))
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            line[rng.randrange(len(line))] = rng.choice('0123456789,.-+"\t x')
        lines.append("".join(line))
    got = load(spark, rows_of(lines))
    for i, line in enumerate(lines):
        if not line.strip() or line.startswith("#"):
            continue
        try:
            strict_block_bed(line)
            why = None
        except _Broken as e:
            why = str(e)
        assert got[i + 1].reason == why, line


def test_bulk_equals_strict_on_mutated_all_lines(spark):
    rng = random.Random(8)
    lines = [HEADER]
    for _ in range(2500):
        line = list(ALL)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            line[rng.randrange(len(line))] = rng.choice("0123456789,.-\t eNA")
        lines.append("".join(line))
    got = load(spark, rows_of(lines, "all_tsv", "t"))
    for i, line in enumerate(lines[1:], 2):
        try:
            strict_all(line, read_header(HEADER))
            why = None
        except _Broken as e:
            why = str(e)
        assert got[i].reason == why, line


def test_halving_isolates_single_lines():
    rng = random.Random(3)
    for n in (0, 1, 2, 7, 64, 1000):
        for share in (0.0, 0.06, 1.0):
            sure = np.array([rng.random() >= share for _ in range(n)], dtype=bool)
            passed, alone = clean_stretches(sure)
            assert alone == np.flatnonzero(~sure).tolist()
            assert sorted(i for low, high in passed for i in range(low, high)) == np.flatnonzero(sure).tolist()


def test_valid_lines_are_loaded_by_the_columnar_path(monkeypatch):
    """With 6 % broken lines only those, and lines with tabs or quotes inside quotes, are read by the strict parser."""
    rng = random.Random(9)
    bad = [x for lines in BAD_BED.values() for x in lines]
    lines = [rng.choice(bad) if rng.random() < 0.06 else rng.choice([BED12, BED12.replace("f1", '"f1"'), BED12 + "\r"]) for _ in range(5000)]
    seen = []
    diagnosed = rawlines._diagnosed
    monkeypatch.setattr(rawlines, "_diagnosed", lambda line, *a: seen.append(line) or diagnosed(line, *a))
    n = len(lines)
    batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array(["block_bed"] * n), pa.array(["x"] * n), pa.array(range(n), pa.int64()), pa.array(lines), pa.nulls(n, pa.string())], names=["rec_id", "fmt", "file_name", "line_no", "line", "header"])
    out = pa.Table.from_batches(list(rawlines._load(iter([batch]))))
    assert out.num_rows == n and out.column("reason").null_count == sum(x not in bad for x in lines)
    assert set(seen) <= set(bad)
