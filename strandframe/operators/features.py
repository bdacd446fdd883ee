"""Per-fiber coverage fractions, record counts and distribution summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.annotate import layer_rows, sane_fibers
from strandframe.schemas import LAYERS


def _safe(numerator: Column) -> Column:
    return F.when(F.col("fiber_length") > 0, numerator / F.col("fiber_length")).otherwise(F.lit(0.0))


def fiber_fractions(fibers: DataFrame, layers: dict[str, DataFrame], max_fibers_per_chrom: int | None = None) -> DataFrame:
    """Coverage by intervals (clipped, not unioned), density of calls and share of methylated calls of each sane fiber.

    All layers come to their fibers by one join and one aggregation. Shares among calls are null where there is no call.
    ``max_fibers_per_chrom`` keeps the first fibers by number of each sample and chromosome.
    """
    f = sane_fibers(fibers)
    if max_fibers_per_chrom is not None:
        w = Window.partitionBy("sample", "chrom").orderBy("fiber_int_id")
        f = f.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_fibers_per_chrom).drop("_k")
    f = f.select("sample", "chrom", "fiber_int_id", "fiber_id", F.col("start").alias("fiber_start"), F.col("end").alias("fiber_end"), F.greatest(F.col("end") - F.col("start"), F.lit(0)).alias("fiber_length"))
    names = [n for n in ("nucleosomes", "msp", "5mC", "5hmC", "6mA") if n in layers]
    rows = layer_rows(layers, names)
    points = [n for n in LAYERS if LAYERS[n].kind == "point"]
    inside = ~F.col("layer").isin(points) | ((F.col("ls") >= F.col("fiber_start")) & (F.col("ls") < F.col("fiber_end")))
    on = [F.col(k) == F.col(f"l_{k}") for k in ("sample", "chrom", "fiber_int_id")] + [inside]
    bp = F.greatest(F.least("le", "fiber_end") - F.greatest("ls", "fiber_start"), F.lit(0))
    of = lambda n: F.col("layer") == n
    keys = ["sample", "chrom", "fiber_int_id", "fiber_id", "fiber_start", "fiber_end", "fiber_length"]
    out = f.join(rows, on, "left").groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(of("nucleosomes"), bp)), F.lit(0)).alias("nuc_bp"),
        F.coalesce(F.sum(F.when(of("msp"), bp)), F.lit(0)).alias("msp_bp"),
        *[F.count(F.when(of(n), 1)).alias(f"n_{n}") for n in ("5mC", "5hmC", "6mA")],
        *[F.avg(F.when(of(n), F.col("methylated"))).alias(f"frac_{n}_among_cpg") for n in ("5mC", "5hmC")],
    )
    for c, n in (("frac_nuc_coverage", "nuc_bp"), ("frac_msp_coverage", "msp_bp"), ("frac_5mC_coverage", "n_5mC"), ("frac_5hmC_coverage", "n_5hmC"), ("frac_6mA_coverage", "n_6mA")):
        out = out.withColumn(c, _safe(F.col(n)))
    return out.withColumn("frac_6mA_among_A", F.col("frac_6mA_coverage")).drop("nuc_bp", "msp_bp", "fiber_int_id")


def record_counts(fibers: DataFrame, layers: dict[str, DataFrame], annotations: DataFrame) -> DataFrame:
    """Records per sample, chromosome and layer, with totals per layer (sample and chrom null), zero where a layer is absent."""
    parts = fibers.groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("records")).withColumn("layer", F.lit("fibers"))
    for n, t in layers.items():
        parts = parts.unionByName(t.groupBy("sample", "chrom").agg(F.count(F.lit(1)).alias("records")).withColumn("layer", F.lit(n)))
    totals = parts.groupBy("layer").agg(F.sum("records").alias("records"))
    names = fibers.sparkSession.createDataFrame([(n,) for n in ("fibers", *LAYERS)], "layer string")
    totals = names.join(totals, "layer", "left").select(F.lit(None).cast("string").alias("sample"), F.lit(None).cast("string").alias("chrom"), "layer", F.coalesce("records", F.lit(0)).alias("records"))
    regions = annotations.agg(F.count(F.lit(1)).alias("records")).select(F.lit(None).cast("string").alias("sample"), F.lit(None).cast("string").alias("chrom"), F.lit("annotations").alias("layer"), "records")
    return parts.select("sample", "chrom", "layer", "records").unionByName(totals).unionByName(regions)


def summary_statistics(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median, quartiles and 95th percentile (linear between ranks), with least, largest and count."""
    p = F.percentile(value, F.array(*[F.lit(x) for x in (0.5, 0.25, 0.75, 0.95)]))
    out = rows.groupBy(*keys).agg(p.alias("p"), F.min(value).alias("least"), F.max(value).alias("largest"), F.count(value).alias("n"))
    return out.select(*keys, *[F.col("p")[i].alias(c) for i, c in enumerate(("median", "q25", "q75", "p95"))], "least", "largest", "n")


def trimmed_summary(rows: DataFrame, keys: list[str], value: str, size: str, outlier: int = 10_000) -> DataFrame:
    """The statistics without rows whose ``size`` reaches ``outlier``."""
    return summary_statistics(rows.where(F.col(size) < outlier), keys, value)


def ecdf(rows: DataFrame, keys: list[str], value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Points (x, y) of the empirical distribution per group, one for each row, from (low, 0) to (high, 1).

    The i-th of n sorted values has y = i / n; equal values have rising y. Rows are counted by value first, so that only
    distinct values are put in order. Nulls and NaN are left out; a group without a value gives no point.
    """
    per = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("x")
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    steps = per.withColumn("before", upto - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    points = steps.select(*keys, "x", "before", "all", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))
    points = points.select(*keys, "x", ((F.col("before") + F.col("i")) / F.col("all")).alias("y"))
    ends = per.select(*keys).distinct().select(*keys, F.inline(F.array(F.struct(F.lit(low).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(high).alias("x"), F.lit(1.0).alias("y")))))
    return points.unionByName(ends)
