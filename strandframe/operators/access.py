"""Look-ups of fibers, calls and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.annotate import sane_fibers
from strandframe.operators.intervals import Overlap, range_join
from strandframe.operators.ordering import numbered_within, running_total
from strandframe.session import broadcast_if_small


def fibers_at(fibers: DataFrame, chrom: str, start: int, end: int, sample: str | None = None) -> DataFrame:
    """Sane fibers that strictly overlap a region of a sample (null: the first by name); an empty region has none."""
    if sample is None:
        first = fibers.agg(F.min("sample").alias("_first"))
        fibers = fibers.join(F.broadcast(first), F.col("sample") == F.col("_first"), "left_semi")
    else:
        fibers = fibers.where(F.col("sample") == sample)
    if end <= start:
        return fibers.limit(0)
    return sane_fibers(fibers).where((F.col("chrom") == chrom) & (F.col("end") > start) & (F.col("start") < end))


def overlapping_fibers(fibers: DataFrame, regions: DataFrame, overlap: Overlap = Overlap.INCLUSIVE) -> DataFrame:
    """Region and fiber pairs; ``regions`` has chrom, start, end and ord."""
    f = sane_fibers(fibers).select("sample", "chrom", "fiber_int_id", F.col("start").alias("fs"), F.col("end").alias("fe"))
    r = regions.select("chrom", "ord", F.col("start").alias("rs"), F.col("end").alias("re"))
    return range_join(f, r, ["chrom"], overlap)


def spanning_fibers(fibers: DataFrame, regions: DataFrame, min_coverage: float = 0.8) -> DataFrame:
    """Pairs in which the fiber covers at least ``min_coverage`` of the region; an empty region has none."""
    pairs = overlapping_fibers(fibers, regions).where("re > rs")
    share = (F.least("fe", "re") - F.greatest("fs", "rs")) / (F.col("re") - F.col("rs"))
    return pairs.withColumn("coverage", share).where(F.col("coverage") >= min_coverage)


def calls_of_fiber(layer: DataFrame, fibers: DataFrame, fiber_id: str, chrom: str, sample: str) -> DataFrame:
    """A layer's calls on one fiber, in input order."""
    one = fibers.where((F.col("fiber_id") == fiber_id) & (F.col("chrom") == chrom) & (F.col("sample") == sample)).select("sample", "chrom", "fiber_int_id")
    return layer.join(F.broadcast(one.limit(1)), ["sample", "chrom", "fiber_int_id"], "left_semi").orderBy("ord", "pos" if "pos" in layer.columns else "start")


def fiber_lookup(fibers: DataFrame) -> DataFrame:
    """sample, fiber_id and chromosome; of an id on several chromosomes the last by name is given."""
    return fibers.groupBy("sample", "fiber_id").agg(F.max("chrom").alias("chrom"))


def fiber_int_ids(rows: DataFrame) -> DataFrame:
    """Dense numbers of read ids within sample and chromosome, in order of the id as text."""
    return numbered_within(rows.select("sample", "chrom", "fiber_id").distinct(), ["sample", "chrom"], ["fiber_id"], "fiber_int_id")


def layer_slices(layer: DataFrame) -> DataFrame:
    """Row range of each fiber in the stored order of its sample and chromosome: start_row, end_row."""
    per = layer.groupBy("sample", "chrom", "fiber_int_id").agg(F.count(F.lit(1)).alias("n"))
    whole = running_total(per, ["sample", "chrom", "fiber_int_id"], "n", "upto")
    begins = whole.groupBy(F.col("sample").alias("_s"), F.col("chrom").alias("_c")).agg(F.min(F.col("upto") - F.col("n")).alias("begin"))
    placed = whole.join(broadcast_if_small(begins, ["_s", "_c"]), F.col("sample").eqNullSafe(F.col("_s")) & F.col("chrom").eqNullSafe(F.col("_c")))
    end = F.col("upto") - F.col("begin")
    return placed.select("sample", "chrom", "fiber_int_id", (end - F.col("n")).alias("start_row"), end.alias("end_row"))


def chromosomes(fibers: DataFrame) -> DataFrame:
    """sample and chrom of chromosomes proper (named chr...), with their number of fibers."""
    return fibers.where(F.col("chrom").startswith("chr")).groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("n_fibers"))


def annotation_types(regions: DataFrame) -> DataFrame:
    return regions.groupBy("annotation").agg(F.count(F.lit(1)).alias("n_regions"))


def annotation_regions(regions: DataFrame, annotation: str) -> DataFrame:
    """Regions of a type in file order; a missing id is made up of the type and the place."""
    w = Window.partitionBy("annotation").orderBy("ord")
    rows = regions.where(F.col("annotation") == annotation).withColumn("_k", F.row_number().over(w) - 1)
    return rows.withColumn("id", F.coalesce("id", F.concat(F.col("annotation"), F.lit("_"), F.col("_k").cast("string")))).drop("_k").orderBy("ord")


def regions_by_chromosome(regions: DataFrame) -> DataFrame:
    """chrom and its ``regions``, each with start, end and id, in order of their starts: one row a chromosome, for loops over them."""
    return regions.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("start", "end", "id"))).alias("regions"))


def annotation_by_id(regions: DataFrame, region_id: str) -> DataFrame:
    """First region, in file order, with an id, looked for under the type that the id names without its last part."""
    kind = region_id.rpartition("_")[0] or region_id
    return regions.where((F.col("annotation") == kind) & (F.col("id") == region_id)).orderBy("ord").limit(1)
