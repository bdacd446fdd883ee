"""Per-(region, fiber) summaries of layers: the flagship query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.intervals import Overlap, range_join
from strandframe.schemas import LAYERS, MAX_FIBER_SPAN
from strandframe.session import broadcast_if_small, checkpointed

DEFAULT_LAYERS = ("nucleosomes", "5mC")
_KEYS = ["sample", "chrom", "fiber_int_id"]


def sane_fibers(fibers: DataFrame) -> DataFrame:
    """Fibers without the over-long and the reversed ones."""
    return fibers.where((F.col("end") - F.col("start")).between(0, MAX_FIBER_SPAN))


def fibers_of_regions(regions: DataFrame, fibers: DataFrame, overlap: Overlap) -> DataFrame:
    """Candidates: each region occurrence (ord, annotation, chrom, start, end) with each sane fiber it meets."""
    f = sane_fibers(fibers).select("sample", "chrom", "fiber_int_id", "fiber_id", F.col("start").alias("fs"), F.col("end").alias("fe"))
    r = regions.select("chrom", "ord", "annotation", "id", F.col("start").alias("rs"), F.col("end").alias("re"))
    return range_join(f, r, ["chrom"], overlap)


def layer_rows(layers: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """The calls of several layers in one frame, so that one shuffle brings all of them to their fibers."""
    out = None
    for n in names:
        t, kind = layers[n], LAYERS[n].kind
        has = lambda c, d=None, t=t: F.col(c) if c in t.columns else F.lit(d)
        rows = t.select(
            *[F.col(k).alias(f"l_{k}") for k in _KEYS],
            F.lit(n).alias("layer"),
            (F.col("start") if kind == "interval" else F.col("pos")).cast("long").alias("ls"),
            (F.col("end") if kind == "interval" else F.col("pos")).cast("long").alias("le"),
            has("width").cast("long").alias("width"),
            has("linker").cast("double").alias("linker"),
            has("score").cast("double").alias("score"),
            has("is_methylated").cast("double").alias("methylated"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def _meets() -> Column:
    """A layer's rule for a call to count in a region."""
    ls, le, rs, re = (F.col(c) for c in ("ls", "le", "rs", "re"))
    return (
        F.when(F.col("layer") == "fire_accessibility", Overlap.INCLUSIVE.on(ls, le, rs, re))
        .when(F.col("layer").isin("nucleosomes", "msp"), Overlap.CONTAINED.on(ls, le, rs, re))
        .otherwise(Overlap.CLOSED_POINT.on(ls, le, rs, re))
    )


def _metrics(names: list[str]) -> list[Column]:
    of = lambda n: F.col("layer") == n
    count = lambda n, name: F.count(F.when(of(n), 1)).alias(name)
    mean = lambda n, c, name: F.avg(F.when(of(n), F.col(c))).alias(name)
    out: list[Column] = []
    for n in names:
        if n == "nucleosomes":
            out += [count(n, "n_nucleosomes"), mean(n, "width", "mean_nuc_width"), F.avg(F.when(of(n) & (F.col("linker") >= 0), F.col("linker"))).alias("mean_linker")]
        elif n == "5mC":
            out += [count(n, "n_cpg"), (100 * F.avg(F.when(of(n), F.col("methylated")))).alias("pct_methylated")]
        elif n == "5hmC":
            out += [count(n, "n_5hmC"), (100 * F.avg(F.when(of(n), F.col("methylated")))).alias("pct_hydroxymethylated")]
        elif n == "6mA":
            out += [count(n, "n_6mA")]
        elif n == "msp":
            out += [count(n, "n_msp"), mean(n, "width", "mean_msp_width")]
        else:
            bp = F.greatest(F.least("le", "re") - F.greatest("ls", "rs"), F.lit(0))
            out += [
                count(n, "n_fire_accessibility"),
                F.min(F.when(of(n), F.col("score"))).alias("min_fire_score"),
                mean(n, "score", "mean_fire_score"),
                F.sum(F.when(of(n), bp)).alias("fire_overlap_bp"),
            ]
    return out


_COUNT_OF = {"nucleosomes": "n_nucleosomes", "5mC": "n_cpg", "5hmC": "n_5hmC", "6mA": "n_6mA", "msp": "n_msp", "fire_accessibility": "n_fire_accessibility"}


def summarise(regions: DataFrame, fibers: DataFrame, layers: dict[str, DataFrame], feature_types: list[str], overlap: Overlap = Overlap.INCLUSIVE, missing_as_null: bool = True) -> DataFrame:
    """One row per region occurrence and fiber, with the metrics of each layer asked for.

    Calls are brought to their fibers by one equi-join and reduced by one aggregation, whatever the number of
    layers. A fiber without a call counts 0 and has null means; with ``missing_as_null`` the counts of a layer that
    isn't stored at all for a sample and chromosome are null. Unknown layer names are ignored, as are layers without a table.
    """
    names = [n for n in feature_types if n in layers and n in LAYERS]
    # the candidates are read three times: kept, they also let each layer be cut to their fibers before it is shuffled
    cand = checkpointed(fibers_of_regions(regions, fibers, overlap))
    group = ["ord", "annotation", "id", "chrom", "rs", "re", "sample", "fiber_int_id", "fiber_id"]
    if not names:
        return cand.select(*group)
    rows = layer_rows(layers, names)
    on = [F.col(k) == F.col(f"l_{k}") for k in _KEYS] + [_meets()]
    wanted = broadcast_if_small(cand.select(*[F.col(k).alias(f"w_{k}") for k in _KEYS]).distinct(), [f"w_{k}" for k in _KEYS[:2]])
    near = rows.join(wanted, [F.col(f"l_{k}") == F.col(f"w_{k}") for k in _KEYS], "left_semi")
    out = cand.join(near, on, "left").groupBy(*group).agg(*_metrics(names))
    if "nucleosomes" in names:
        out = out.withColumn("mean_repeat_length", F.col("mean_nuc_width") + F.col("mean_linker"))
    if missing_as_null:
        # a few rows: one for each sample and chromosome
        there = rows.groupBy("l_sample", "l_chrom").agg(*[F.max(F.when(F.col("layer") == n, True)).alias(f"_has_{i}") for i, n in enumerate(names)])
        there = there.select(F.col("l_sample").alias("_s"), F.col("l_chrom").alias("_c"), *[f"_has_{i}" for i in range(len(names))])
        out = out.join(there, (F.col("sample") == F.col("_s")) & (F.col("chrom") == F.col("_c")), "left")
        for i, n in enumerate(names):
            out = out.withColumn(_COUNT_OF[n], F.when(F.col(f"_has_{i}"), F.col(_COUNT_OF[n])))
        out = out.drop("_s", "_c", *[f"_has_{i}" for i in range(len(names))])
    return out


def of_sample(sample: str, fibers: DataFrame, layers: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Fibers and layers of one sample, as a filter that reaches the scan (and prunes a store's partitions)."""
    return fibers.where(F.col("sample") == sample), {n: x.where(F.col("sample") == sample) for n, x in layers.items()}


def query_annotation(regions: DataFrame, fibers: DataFrame, layers: dict[str, DataFrame], annotation: str | None, sample: str | None, feature_types: list[str] | None = None, max_regions: int | None = None) -> DataFrame:
    """Summaries of the regions of a type (null: all types) in a sample (null: all samples).

    ``max_regions`` takes the first regions in file order; 0 or null means all. An unknown type or sample gives no rows.
    ``region_id`` is chrom:start-end, which is no key where a region is listed twice; each listing has its own rows.
    """
    if annotation is not None:
        regions = regions.where(F.col("annotation") == annotation)
    if max_regions:
        regions = regions.orderBy("ord").limit(max_regions)
    if sample is not None:
        fibers, layers = of_sample(sample, fibers, layers)
    out = summarise(regions, fibers, layers, list(feature_types or DEFAULT_LAYERS))
    return out.withColumn("region_id", region_name("chrom", "rs", "re")).drop("id", "rs", "re", "chrom", "fiber_int_id")


def query_by_id(regions: DataFrame, fibers: DataFrame, layers: dict[str, DataFrame], region_id: str, sample: str, feature_types: list[str] | None = None) -> DataFrame:
    """Summaries of the one region with an id: strict overlap of fibers, absent layers count 0, fewer metrics.

    The region's type is the id without its last ``_token``; of several rows the first in file order holds.
    """
    kind, _, _ = region_id.rpartition("_")
    one = regions.where((F.col("id") == region_id) & (F.col("annotation") == (kind or region_id))).orderBy("ord").limit(1)
    out = summarise(one, *of_sample(sample, fibers, layers), list(feature_types or LAYERS), Overlap.STRICT, missing_as_null=False)
    drop = ["mean_linker", "mean_repeat_length", "n_5hmC", "pct_hydroxymethylated", "mean_msp_width", "fire_overlap_bp", "annotation", "ord", "chrom", "rs", "re", "fiber_int_id"]
    return out.drop(*drop).withColumnRenamed("id", "region_id")


def compare_samples(regions: DataFrame, fibers: DataFrame, layers: dict[str, DataFrame], annotation: str, feature_types: list[str] | None = None, max_regions: int | None = None) -> DataFrame:
    """The summaries of all samples under each other, in one job."""
    return query_annotation(regions, fibers, layers, annotation, None, feature_types, max_regions)


def region_name(chrom: str, start: str, end: str) -> Column:
    return F.concat(F.col(chrom), F.lit(":"), F.col(start).cast("string"), F.lit("-"), F.col(end).cast("string"))
