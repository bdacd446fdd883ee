import math

import pytest
from pyspark.sql import functions as F

from strandframe.functions.quantities import fractions, recorded_units, run_units
from strandframe.functions.units import cell_unit, note_units, segment, to_fraction

M5C = "call_id long, run_id string, prob string"
REC = "all_id long, run_id string, m5c_qual string, m6a_qual string"
RUNS = "run_id string, scale_note string"


@pytest.mark.parametrize(
    ("affix", "unit"),
    [("%", "percent"), (" pct", "percent"), (" percent", "percent"), (" per cent", "percent"), ("‰", "permille"), ("per mille", "permille"), ("/255", "byte"), (" / 255", "byte"), ("Q", "phred"), ("p=", "fraction"), ("P = ", "fraction"), ("", None), ("reads", None), ("ml", None)],
)
def test_units_of_cells(affix, unit):
    assert cell_unit(affix) == unit


@pytest.mark.parametrize(
    ("note", "said"),
    [
        ("prob scaled 0-1000", {"prob": "permille"}),
        ("all likelihoods in percent", {"prob": "percent", "m5c_qual": "percent", "m6a_qual": "percent"}),
        ("call probability written in per cent", {"prob": "percent"}),
        ("export v3 (fractions / bytes)", {"prob": "fraction", "m5c_qual": "byte", "m6a_qual": "byte"}),
        ("prob = byte 0-255, while the ML lists are 0..1", {"prob": "byte", "m5c_qual": "fraction", "m6a_qual": "fraction"}),
        ("prob column holds the raw ML byte (0-255)", {"prob": "byte"}),
        ("prob not yet divided by 255", {"prob": "byte"}),
        ("probabilities divided by 255 at export; lists untouched", {"prob": "fraction", "m5c_qual": "byte", "m6a_qual": "byte"}),
        ("quality lists phred-like: -10 log10(1-p)", {"m5c_qual": "phred", "m6a_qual": "phred"}),
        ("m6A lists in percent", {"m6a_qual": "percent"}),
        ("prob = ML / 255", {"prob": "fraction"}),
        ("probabilities in thousandths", {"prob": "permille"}),
        ("prob stored as phred of the error 1-p", {"prob": "phred"}),
        ("values per 10000", dict.fromkeys(("prob", "m5c_qual", "m6a_qual"), "per_10000")),
        ("scaled 0-65535", dict.fromkeys(("prob", "m5c_qual", "m6a_qual"), "per_65535")),
        ("parts per million", dict.fromkeys(("prob", "m5c_qual", "m6a_qual"), "per_1000000")),
        ("prob in ppm", {"prob": "per_1000000"}),
        ("prob ×100", {"prob": "percent"}),
        ("prob 0-99", {"prob": "per_99"}),
        ("prob times 10^3", {"prob": "permille"}),
        ("probabilities multiplied by 2³", {"prob": "per_8"}),
        ("prob as uint16", {"prob": "per_65535"}),
        ("8-bit probabilities", {"prob": "byte"}),
        ("prob in hundredths", {"prob": "percent"}),
        ("prob not yet divided by 1000", {"prob": "permille"}),
        ("kept 100 percent of reads", {}),
        ("percent of reads passing 90%", {}),
        ("yield 0-100 reads", {}),
        ("prob passed in 90 % of the runs", {}),
        ("percentile bins", {}),
        ("half flow cell, low yield", {}),
        ("checked by bench team", {}),
        ("3 ml added, 255 reads lost", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_notes(note, said):
    assert note_units(note) == said


def test_ambiguous_pieces_follow_the_prior():
    assert ("field", "qual") in segment("ML lists")
    assert all(kind != "foreign" for kind, _ in segment("ml q per cent"))
    assert ("foreign", "millilitre") in segment("ml", "volume") and ("foreign", "thou") in segment("mil", "length")


def test_conversion():
    assert to_fraction(50, "percent") == 0.5 and to_fraction(255, "byte") == 1 and to_fraction(500, "permille") == 0.5
    assert math.isclose(to_fraction(10, "phred"), 0.9) and to_fraction(5000, "per_10000") == 0.5


def tables(spark, m5c=(), records=(), runs=()):
    return (
        spark.createDataFrame(list(m5c), M5C).withColumn("unit", F.lit("clash")),
        spark.createDataFrame(list(records), REC).withColumn("cell", F.lit("clash")),
        spark.createDataFrame(list(runs), RUNS).withColumn("field", F.lit(1)),
    )


def units(spark, **kw):
    return {(r.src_table, r.row_id, r.field): r.unit for r in recorded_units(*tables(spark, **kw)).collect()}


def test_cell_before_note_before_values(spark):
    m5c = [(1, "a", "84.5"), (2, "a", "p=0.5"), (3, "b", "84"), (4, "b", "3"), (5, "c", "0,5"), (6, "c", "1/255"), (7, None, "0.2"), (8, "a", "NA"), (9, "a", " nan "), (10, "a", "."), (11, "a", ""), (12, "a", None), (13, "d", "400"), (14, "d", "900"), (15, "d", "1e2")]
    got = units(spark, m5c=m5c, runs=[("a", "prob in per mille"), ("b", None), ("c", "topped up")])
    want = {1: "permille", 2: "fraction", 3: "percent", 4: "percent", 5: "fraction", 6: "byte", 7: "fraction", 13: "permille", 14: "permille", 15: "permille"}
    assert got == {("m5c", k, "prob"): u for k, u in want.items()}


def test_lists(spark):
    rec = [(1, "a", "97%,3%,.", "10,200,255,"), (2, "a", "1/255,.", ".,NA"), (3, "b", "0.1,0.9", "Q3.1,Q9"), (4, "a", None, "250"), (5, "z", "12", "")]
    got = units(spark, records=rec)
    assert got == {
        ("all_records", 1, "m5c_qual"): "percent", ("all_records", 1, "m6a_qual"): "byte", ("all_records", 2, "m5c_qual"): "byte", ("all_records", 3, "m5c_qual"): "fraction",
        ("all_records", 3, "m6a_qual"): "phred", ("all_records", 4, "m6a_qual"): "byte", ("all_records", 5, "m5c_qual"): "phred",
    }


def test_fractions_keep_places(spark):
    rec = [(1, "a", "97%,.,3%", None), (2, "a", "51/255", None)]
    rows = fractions(recorded_units(*tables(spark, records=rec))).collect()
    got = {(r.row_id, r.pos): r.fraction for r in rows}
    assert got[1, 0] == pytest.approx(0.97) and got[1, 1] is None and got[1, 2] == pytest.approx(0.03) and got[2, 0] == pytest.approx(0.2)


def test_scales_of_any_size_and_several_notes_of_a_run(spark):
    m5c = [(1, "a", "5000"), (2, "b", "0.5"), (3, "c", "50")]
    runs = [("a", "values per 10000"), ("b", "prob in percent"), ("b", "prob in per mille"), ("c", "night run"), ("c", "prob in percent")]
    cells = recorded_units(*tables(spark, m5c=m5c, runs=runs))
    got = {r.row_id: (r.unit, r.fraction) for r in fractions(cells).collect()}
    assert got == {1: ("per_10000", 0.5), 2: ("fraction", 0.5), 3: ("percent", 0.5)}


def test_empty_tables(spark):
    assert units(spark) == {}
    assert run_units(*tables(spark)).count() == 0
