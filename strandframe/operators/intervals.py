"""Range joins and other operators on intervals."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import BROADCAST_LIMIT_BYTES, checkpointed

BIN_WIDTH = 1 << 14


class Overlap(Enum):
    """How a feature [fs, fe) meets a region [rs, re)."""

    STRICT = "fe > rs and fs < re"
    INCLUSIVE = "fe >= rs and fs <= re"
    CONTAINED = "fs >= rs and fe <= re"
    CLOSED_POINT = "fs between rs and re"

    def on(self, fs: Column, fe: Column, rs: Column, re: Column) -> Column:
        if self is Overlap.STRICT:
            return (fe > rs) & (fs < re)
        if self is Overlap.INCLUSIVE:
            return (fe >= rs) & (fs <= re)
        if self is Overlap.CONTAINED:
            return (fs >= rs) & (fe <= re)
        return (fs >= rs) & (fs <= re)


def is_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES, row_bytes: int = 128) -> bool:
    """Whether a frame has few enough rows to be broadcast; at most limit / row_bytes + 1 rows are counted."""
    most = limit // row_bytes
    return df.limit(most + 1).count() <= most


def overlap_bp(fs: Column, fe: Column, rs: Column, re: Column) -> Column:
    """Length of the common part, 0 where there is none."""
    return F.greatest(F.least(fe, re) - F.greatest(fs, rs), F.lit(0))


def range_join(features: DataFrame, regions: DataFrame, keys: list[str], overlap: Overlap, extra: Column | None = None, bin_width: int = BIN_WIDTH, broadcast: bool | None = None) -> DataFrame:
    """Pairs of features (fs, fe) and regions (rs, re) that have equal ``keys`` and meet as ``overlap`` says.

    ``regions`` must not share column names with ``features`` but for ``keys``. Where the regions are few (they are
    counted) they are broadcast and the range is a condition of the hash join. Else both sides are spread over
    bins of ``bin_width`` and joined by key and bin, a pair being kept in the first bin that both have; a hot
    chromosome is so split over its bins. Null keys or bounds meet nothing; repeated rows pair each.
    """
    cond = overlap.on(F.col("fs"), F.col("fe"), F.col("rs"), F.col("re"))
    if extra is not None:
        cond = cond & extra
    if broadcast is None:
        broadcast = is_small(regions)
    right = regions.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in regions.columns if c not in keys])
    same = [F.col(k) == F.col(f"_r_{k}") for k in keys]
    if broadcast:
        out = features.join(F.broadcast(right), [*same, cond], "inner")
        return out.drop(*[f"_r_{k}" for k in keys])
    of = lambda c: F.floor(F.col(c) / F.lit(bin_width)).cast("long")
    spread = lambda a, b: F.explode(F.sequence(of(a), F.greatest(of(a), of(b))))
    left = features.where("fs is not null and fe is not null").withColumn("_bin", spread("fs", "fe"))
    right = right.where("rs is not null and re is not null").withColumn("_rbin", spread("rs", "re"))
    first = F.col("_bin") == F.greatest(of("fs"), of("rs"))
    out = left.join(right, [*same, F.col("_bin") == F.col("_rbin"), first, cond], "inner")
    return out.drop("_bin", "_rbin", *[f"_r_{k}" for k in keys])


def range_anti(features: DataFrame, regions: DataFrame, keys: list[str], overlap: Overlap) -> DataFrame:
    """Features that meet no region; features with a null key or bound meet none and are kept."""
    right = regions.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "rs", "re")
    if is_small(right):
        on = [F.col(k) == F.col(f"_r_{k}") for k in keys]
        return features.join(F.broadcast(right), [*on, overlap.on(F.col("fs"), F.col("fe"), F.col("rs"), F.col("re"))], "left_anti")
    numbered = checkpointed(features.withColumn("_row", F.monotonically_increasing_id()))
    hit = range_join(numbered, regions.select(*keys, "rs", "re"), keys, overlap, broadcast=False).select("_row").distinct()
    return numbered.join(hit, "_row", "left_anti").drop("_row")


def contained_pairs(stitched: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements (chrom, start, end) within a stitched region: chrom, es, ee, ss, se. Empty elements are in none."""
    e = elements.select("chrom", F.col("start").alias("fs"), F.col("end").alias("fe"))
    s = stitched.select("chrom", F.col("start").alias("rs"), F.col("end").alias("re"))
    pairs = range_join(e, s, ["chrom"], Overlap.CONTAINED, F.col("re") > F.col("fs"))
    return pairs.select("chrom", F.col("fs").alias("es"), F.col("fe").alias("ee"), F.col("rs").alias("ss"), F.col("re").alias("se"))


def stitch(peaks: DataFrame, genes: DataFrame, distance: int) -> DataFrame:
    """Merge peaks (chrom, start, end) into islands: chrom, start, end.

    A peak opens an island where no peak lies before it on its chromosome, where the gap to the largest end so far exceeds
    ``distance``, or where a gene (chrom, start, end) covers the whole gap and reaches into both sides. Peaks of a chromosome
    are windowed in order; there are no more than the chromosome has room for.
    """
    order = Window.partitionBy("chrom").orderBy("start", "end")
    rows = peaks.select("chrom", "start", "end").withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    g = genes.select(F.col("chrom").alias("g_chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end"))
    # only a gap within the distance needs to know of genes
    open_gaps = rows.where((F.col("start") - F.col("reach")).between(F.lit(-(1 << 62)), F.lit(distance))).select("chrom", "start", "reach").distinct()
    crossing = (F.col("g_chrom") == F.col("chrom")) & (F.col("g_start") < F.col("start")) & (F.col("g_end") > F.col("reach"))
    blocked = open_gaps.join(F.broadcast(g) if is_small(g) else g, crossing, "left_semi").select("chrom", "start", "reach", F.lit(True).alias("blocked"))
    rows = rows.join(blocked, ["chrom", "start", "reach"], "left")
    opens = F.col("reach").isNull() | (F.col("start") - F.col("reach") > distance) | F.col("blocked").isNotNull()
    rows = rows.withColumn("island", F.sum(opens.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
