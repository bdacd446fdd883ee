"""Plot-ready rows: molecules of a region with their segments and ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.access import fibers_at
from strandframe.schemas import LAYERS


def single_molecule_rows(fibers: DataFrame, layers: dict[str, DataFrame], chrom: str, start: int, end: int, sample: str | None = None, tracks: tuple[str, ...] = ("nucleosomes", "5mC"), max_fibers: int | None = None) -> DataFrame:
    """Segments and ticks of the fibers of a region: fiber_id, track, left, right (clipped), value.

    Fibers are taken in order of their id, the first ``max_fibers`` of them. Intervals are cut to the region and kept where
    something is left; calls count from the start up to the end.
    """
    found = fibers_at(fibers, chrom, start, end, sample).select("sample", "chrom", "fiber_int_id", "fiber_id", F.col("start").alias("fs"), F.col("end").alias("fe"))
    if max_fibers is not None:
        found = found.orderBy("fiber_id").limit(max_fibers)
    out = found.select("fiber_id", F.lit("fiber").alias("track"), F.greatest("fs", F.lit(start)).alias("left"), F.least("fe", F.lit(end)).alias("right"), F.lit(None).cast("double").alias("value"))
    for n in tracks:
        if n not in layers:
            continue
        t = layers[n]
        point = LAYERS[n].kind == "point"
        a, b = (F.col("pos"), F.col("pos") + 1) if point else (F.col("start"), F.col("end"))
        value = F.col("is_methylated").cast("double") if "is_methylated" in t.columns else F.col("score") if "score" in t.columns else F.lit(None).cast("double")
        rows = t.select("sample", "chrom", "fiber_int_id", a.alias("a"), b.alias("b"), value.alias("value"))
        rows = rows.where((F.col("chrom") == chrom) & (F.col("b") > start) & (F.col("a") < end)).join(F.broadcast(found) if max_fibers is not None and max_fibers <= 10_000 else found, ["sample", "chrom", "fiber_int_id"])
        left, right = F.greatest("a", F.lit(start)), F.least("b", F.lit(end))
        out = out.unionByName(rows.select("fiber_id", F.lit(n).alias("track"), left.alias("left"), right.alias("right"), "value").where("right > left"))
    return out
