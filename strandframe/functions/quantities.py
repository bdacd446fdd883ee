"""Probabilities recorded in different units, brought to fractions.

A value is in the unit its cell shows; else in the unit the note of its run states for the field;
else in the unit that the run's other bare values of the field fit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions.units import OWN_UNIT, cell_unit, note_units
from strandframe.session import broadcast_if_small, checkpointed

#: A cell of nothing but numbers, list commas and missing tokens; Java and DuckDB read it alike.
BARE = r"^[-+0-9.,eE \t]*$"
_HAS_VALUE = r"[0-9]"
#: Share of a run's bare values that must lie above a scale's end before the scale is ruled out: broken values are rarer.
STRAY = 0.02
#: A call is wrong with a probability of 10^-4.5 at the least, so a phred value ends here, well below the values of percents.
_PHRED_END = 45.0

QUALITY_FIELDS = ("m5c_qual", "m6a_qual")


def _clean(c: str) -> Column:
    """The cell without its missing tokens (null, '.', NA, nan), which are no values."""
    return F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?i)(^|,)\s*(na|nan|\.)\s*(?=,|$)", "$1")


def _numbers(c: str, is_list: bool) -> Column:
    parts = F.split(F.col(c), ",") if is_list else F.array(F.regexp_replace(c, ",", "."))
    return F.transform(parts, lambda x: x.try_cast("double"))


def _count_above(values: str, end: float) -> Column:
    return F.size(F.filter(values, lambda x: x > end))


def _evidence(cells: DataFrame, fields: list[str], is_list: bool) -> DataFrame:
    """Per run and field: how many bare values there are, and how many lie above the end of each scale."""
    picked = []
    for f in fields:
        bare = cells.select("run", F.lit(f).alias("field"), F.col(f).alias("cell")).where(F.col("cell").rlike(BARE) & F.col("cell").rlike(_HAS_VALUE))
        v = bare.select("run", "field", _numbers("cell", is_list).alias("v"))
        above = [_count_above("v", e).alias(f"a{k}") for k, e in enumerate((1.0, _PHRED_END, 100.0, 255.0))]
        v = v.select("run", "field", F.size(F.filter("v", lambda x: x.isNotNull())).alias("n"), *above)
        picked.append(v.groupBy("run", "field").agg(*[F.sum(c).alias(c) for c in ("n", "a0", "a1", "a2", "a3")]))
    out = picked[0]
    for p in picked[1:]:
        out = out.unionByName(p)
    return out


def _fitting_unit() -> Column:
    """The narrowest scale that holds all but stray values."""
    more = lambda c: F.col(c) > F.greatest(F.lit(STRAY) * F.col("n"), F.lit(0.5))
    return F.when(more("a3"), "permille").when(more("a2"), "byte").when(more("a1"), "percent").when(more("a0"), "phred").otherwise("fraction")


def _read_notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        said = [(r, f, u) for r, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f, u in note_units(n).items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in said], pa.string()) for i in range(3)], names=["run", "field", "noted"])


def run_units(m5c: DataFrame, records: DataFrame, runs: DataFrame) -> DataFrame:
    """Unit of the bare values of each run and field: ``run``, ``field``, ``bare_unit``.

    A note decides; without one, or where the notes of a run contradict one another, the run's bare values do. A run without either has no row, and its
    values stand in the field's own unit. A null run_id counts as one run of its own.
    """
    run = F.coalesce(F.col("run_id"), F.lit("")).alias("run")
    noted = (
        runs.where("run_id is not null and scale_note is not null")
        .select(run, "scale_note")
        .distinct()
        .mapInArrow(_read_notes, "run string, field string, noted string")
        .groupBy("run", "field")
        .agg(F.min("noted").alias("noted"), F.max("noted").alias("other"))
        .where("noted = other")
        .drop("other")
    )
    seen = _evidence(m5c.select(run, _clean("prob").alias("prob")), ["prob"], False).unionByName(
        _evidence(records.select(run, *[_clean(f).alias(f) for f in QUALITY_FIELDS]), list(QUALITY_FIELDS), True)
    )
    both = seen.join(noted, ["run", "field"], "full_outer")
    return both.select("run", "field", F.coalesce("noted", F.when(F.col("n") > 0, _fitting_unit())).alias("bare_unit")).where("bare_unit is not null")


def _affix_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.compute as pc

    cache: dict[str, str | None] = {}
    for batch in batches:
        # one entry shows the unit of its whole list; what stands around its number is the affix
        cell = batch.column("cell")
        affix = pc.replace_substring_regex(cell, r"[-+]?[0-9]+([.,][0-9]+)*([eE][-+]?[0-9]+)?", "\x00")
        affix = pc.replace_substring_regex(affix, "/ *\x00", "/#")
        keep = [i for i, n in enumerate(batch.schema.names) if n != "cell"]
        units = []
        for a, raw in zip(affix.to_pylist(), cell.to_pylist(), strict=True):
            if "/#" in a:
                # a divisor belongs to the unit, so its digits are read back
                a = "/" + raw.split("/", 1)[1].split(",")[0].strip()
            a = a.replace("\x00", "")
            if a not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                cache[a] = next((u for u in (cell_unit(x) for x in a.split(",")) if u), None)
            units.append(cache[a])
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(units, pa.string())], names=[batch.schema.names[i] for i in keep] + ["shown"])


def _per_field(table: DataFrame, id_column: str, fields: list[str], src: str, units: DataFrame) -> DataFrame:
    """src_table, row_id, field, cell and unit of each cell that holds a value."""
    run = F.coalesce(F.col("run_id"), F.lit("")).alias("run")
    base = table.select(run, F.col(id_column).alias("row_id"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), _clean(f).alias("cell")) for f in fields])))
    base = base.where(F.col("cell").rlike(_HAS_VALUE))
    bare = base.where(F.col("cell").rlike(BARE)).withColumn("shown", F.lit(None).cast("string"))
    marked = base.where(~F.col("cell").rlike(BARE)).withColumn("kept", F.col("cell"))
    marked = marked.mapInArrow(_affix_units, "run string, row_id long, field string, kept string, shown string").withColumnRenamed("kept", "cell")
    cells = bare.unionByName(marked).join(units, ["run", "field"], "left")
    own = F.coalesce(*[F.when(F.col("field") == f, F.lit(u)) for f, u in OWN_UNIT.items()])
    return cells.select(F.lit(src).alias("src_table"), "row_id", "field", "cell", F.coalesce("shown", "bare_unit", own).alias("unit"), own.alias("own"))


def recorded_units(m5c: DataFrame, records: DataFrame, runs: DataFrame) -> DataFrame:
    """Unit of every recorded probability: ``src_table``, ``row_id``, ``field``, ``cell``, ``unit``, ``own``.

    One row per cell that holds a value (``m5c.prob``; ``m5c_qual`` and ``m6a_qual`` of ``all_records``, a list
    having one unit). Cells that are null, empty or hold missing tokens only give no row. A cell with text that
    names no unit is taken as bare. Repeated rows are kept; other columns are ignored.
    """
    # a row a run and field; kept, since it is counted and then joined twice
    units = broadcast_if_small(checkpointed(run_units(m5c, records, runs)), ["run", "field"])
    return _per_field(m5c, "call_id", ["prob"], "m5c", units).unionByName(_per_field(records, "all_id", list(QUALITY_FIELDS), "all_records", units))


def _as_fraction(v: Column, unit: Column) -> Column:
    p = (
        F.when(unit == "percent", v / 100.0)
        .when(unit == "permille", v / 1000.0)
        .when(unit == "byte", v / 255.0)
        .when(unit == "phred", 1.0 - F.pow(F.lit(10.0), -v / 10.0))
        .when(unit.startswith("per_"), v / F.substring_index(unit, "_", -1).try_cast("double"))
        .otherwise(v)
    )
    return F.when((p >= 0) & (p <= 1.0), p)


def fractions(cells: DataFrame) -> DataFrame:
    """Each value of ``recorded_units`` as a fraction: src_table, row_id, field, unit, ``pos`` in its list, ``fraction``.

    A missing entry of a list, and a value that is no probability in its unit, has a null fraction; ``pos``
    counts all entries from 0, so that a list keeps its length.
    """
    number = r"([-+]?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
    parts = F.when(F.col("field") == "prob", F.array(F.regexp_replace("cell", ",", "."))).otherwise(F.split(F.regexp_replace("cell", ",$", ""), ","))
    one = cells.select("src_table", "row_id", "field", "unit", F.posexplode(parts).alias("pos", "entry"))
    value = F.regexp_extract("entry", number, 1)
    return one.select("src_table", "row_id", "field", "unit", F.col("pos").cast("long").alias("pos"), _as_fraction(value.try_cast("double"), F.col("unit")).alias("fraction"))
