"""Region by base signal matrices: occupancy, methylation, smoothing, binning and meta-profiles.

A fiber's calls are clipped to the region's window in the JVM; what goes to the kernel of a region is one row a
(region, fiber) with the calls as arrays. A kernel sums over fibers as it goes and holds one region's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.config import METHYLATION_THRESHOLD
from strandframe.operators.access import spanning_fibers
from strandframe.session import broadcast_if_small

# Fixed values of the annotation types.
BODY_BINS = {
    "Promoter": 2500, "Bivalent_Promoter": 2500, "PRC_Promoter": 2500, "CGI": 1000, "DMV": 7000, "Typical_Enhancer": 1000, "Super_Enhancer": 10000,
    "Gene_Body": 30000, "Bivalent_Genebody": 30000, "PRC_Genebody": 30000, "FIRE_d0_Peak": 500, "FIRE_d4_Peak": 500,
}
DEFAULT_BODY_BINS, METAPLOT_BODY_BINS, FLANK_BINS, FLANK_BP = 2500, 200, 100, 2000
MAX_REGION_BP, MIN_FIBER_COVERAGE, MIN_FIBERS = 50_000, 0.8, 10
SMOOTHING_SIGMA, BIN_SIZE, CENTER_METAPLOT_BINS = 50, 50, 400
PROMOTER_TYPES = ("Promoter", "Bivalent_Promoter", "PRC_Promoter")
GENEBODY_TYPES = ("Gene_Body", "Bivalent_Genebody", "PRC_Genebody")
EXTENSION = {
    "CGI": 2500, "DMV": 2500, "Promoter": 2500, "Bivalent_Promoter": 2500, "PRC_Promoter": 2500, "Typical_Enhancer": 2500, "Super_Enhancer": 2500,
    "FIRE_d0_Peak": 2500, "FIRE_d4_Peak": 2500, "Gene_Body": 10000, "Bivalent_Genebody": 10000, "PRC_Genebody": 10000,
}


def is_call(m5c: DataFrame, threshold: float = METHYLATION_THRESHOLD) -> Column:
    """Whether a call is methylated: as the layer says, or by its probability where the layer has no such column; else null."""
    if "is_methylated" in m5c.columns:
        return F.col("is_methylated")
    return F.col("prob") >= F.lit(threshold) if "prob" in m5c.columns else F.lit(None).cast("boolean")


def nan_mean(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(count > 0, total / count, np.nan)


def resize(values: np.ndarray, bins: int) -> np.ndarray:
    """Means over ``bins`` stretches of a vector; a base at an edge counts in both stretches. NaN is no value."""
    values = np.asarray(values, np.float64)
    n = len(values)
    if n == 0:
        return np.full(bins, np.nan)
    if n == bins:
        return values.copy()
    edges = np.linspace(0, n, bins + 1)
    low = np.floor(edges[:-1]).astype(int)
    high = np.minimum(np.maximum(np.ceil(edges[1:]).astype(int), low + 1), n)
    low = np.minimum(low, n - 1)
    total = np.r_[0.0, np.cumsum(np.nan_to_num(values))]
    count = np.r_[0, np.cumsum(~np.isnan(values))]
    return nan_mean(total[high] - total[low], count[high] - count[low])


def gaussian(sigma: float) -> np.ndarray:
    """Weights of a normal curve cut at four sigma, summing to 1."""
    r = int(4 * sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return k / k.sum()


def convolve_same(values: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution of the same length, the vector being mirrored at its ends without repeating the last value."""
    r = len(kernel) // 2
    padded = np.pad(values, r, mode="reflect" if len(values) > 1 else "edge")
    return np.convolve(padded, kernel, mode="valid")


def smooth(values: np.ndarray, sigma: float = SMOOTHING_SIGMA) -> np.ndarray:
    """Gaussian smoothing across gaps: NaN are filled linearly, and set again in the result."""
    values = np.asarray(values, np.float64)
    gap = np.isnan(values)
    if sigma <= 0 or not len(values) or gap.all():
        return values.copy()
    x = np.arange(len(values))
    out = convolve_same(np.interp(x, x[~gap], values[~gap]), gaussian(sigma))
    out[gap] = np.nan
    return out


def occupancy(starts: np.ndarray, ends: np.ndarray, window: int, length: int, fiber: tuple[int, int] | None = None) -> np.ndarray:
    """1 where an interval covers a base of the window; 0 elsewhere, or NaN off the fiber where its span is given."""
    out = np.zeros(length) if fiber is None else np.full(length, np.nan)
    if fiber is not None:
        out[max(fiber[0] - window, 0) : max(min(fiber[1] - window, length), 0)] = 0.0
    low = window if fiber is None else max(window, fiber[0])
    high = window + length if fiber is None else min(window + length, fiber[1])
    for s, e in zip(np.maximum(starts, low) - window, np.minimum(ends, high) - window, strict=True):
        if e > s:
            out[s:e] = 1.0
    return out


def methylation(pos: np.ndarray, called: np.ndarray, window: int, length: int, fiber: tuple[int, int] | None = None) -> np.ndarray:
    """The calls at their bases, NaN elsewhere; of several calls at a base the last holds."""
    out = np.full(length, np.nan)
    keep = (pos >= window) & (pos < window + length)
    if fiber is not None:
        keep &= (pos >= fiber[0]) & (pos < fiber[1])
    out[pos[keep] - window] = called[keep]
    return out


def binned_methylation(rows: list[np.ndarray], length: int, size: int = BIN_SIZE) -> np.ndarray:
    """Mean over fibers of each fiber's mean in stretches of about ``size`` bases."""
    n = max(1, length // size)
    edges = np.linspace(0, length, n + 1).astype(int)
    total, count = np.zeros(n), np.zeros(n)
    for v in rows:
        t, c = np.r_[0.0, np.cumsum(np.nan_to_num(v))], np.r_[0, np.cumsum(~np.isnan(v))]
        mean = nan_mean(t[edges[1:]] - t[edges[:-1]], c[edges[1:]] - c[edges[:-1]])
        seen = ~np.isnan(mean)
        total[seen] += mean[seen]
        count += seen
    return nan_mean(total, count)


def region_fibers(regions: DataFrame, fibers: DataFrame, layers: dict[str, DataFrame], min_coverage: float, flank: Column) -> DataFrame:
    """A row for each region and fiber that spans it, with the fiber's calls near the region as arrays.

    ``flank`` is by how much a region's window reaches beyond it.
    """
    spans = spanning_fibers(fibers, regions, min_coverage).select("ord", "sample", "chrom", "fiber_int_id", "fs", "fe", "rs", "re")
    extra = regions.select(F.col("ord").alias("_ord"), flank.cast("long").alias("flank"))
    spans = spans.join(broadcast_if_small(extra, []), F.col("ord") == F.col("_ord")).drop("_ord")
    keys = ["sample", "chrom", "fiber_int_id"]
    nuc = layers["nucleosomes"].select(*keys, F.lit("n").alias("kind"), F.col("start").alias("a"), F.col("end").alias("b"), F.lit(0.0).alias("v"), "ord")
    met = layers["5mC"].select(*keys, F.lit("m").alias("kind"), F.col("pos").alias("a"), (F.col("pos") + 1).alias("b"), is_call(layers["5mC"]).cast("double").alias("v"), "ord")
    calls = nuc.unionByName(met).where("v is not null and a is not null and b is not null").select(*[F.col(k).alias(f"c_{k}") for k in keys], "kind", "a", "b", "v", F.col("ord").alias("c_ord"))
    on = [F.col(k) == F.col(f"c_{k}") for k in keys] + [F.col("b") > F.col("rs") - F.col("flank"), F.col("a") < F.col("re") + F.col("flank")]
    group = ["ord", "sample", "chrom", "fiber_int_id", "fs", "fe", "rs", "re", "flank"]
    # the calls of one fiber near one region: bounded by the window
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("c_ord", "a", "b", "v"))))
    near = spans.join(calls, on, "left").groupBy(*group).agg(of("n").alias("nuc"), of("m").alias("met"))
    take = lambda c, f: F.transform(c, lambda x: x[f])
    return near.select(*group, take("nuc", "a").alias("nuc_a"), take("nuc", "b").alias("nuc_b"), take("met", "a").alias("met_a"), take("met", "v").alias("met_v"))


def _without_nan(df: DataFrame, *columns: str) -> DataFrame:
    """NaN in vector columns as null."""
    return df.withColumns({c: F.transform(c, lambda x: F.nanvl(x, F.lit(None).cast("double"))) for c in columns})


class _Sum:
    def __init__(self, n: int) -> None:
        self.total, self.count = np.zeros(n), np.zeros(n)

    def add(self, v: np.ndarray) -> None:
        seen = ~np.isnan(v)
        self.total[seen] += v[seen]
        self.count += seen

    def mean(self) -> np.ndarray:
        return nan_mean(self.total, self.count)


_MATRIX = (
    "ord long, sample string, n_fibers long, nuc_body array<double>, met_body array<double>, nuc_meta array<double>, met_meta array<double>, "
    "mean_nuc_occupancy double, mean_methylation double"
)


def _mean(v: np.ndarray) -> float | None:
    return None if np.isnan(v).all() else float(np.nanmean(v))


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, Iterator]]:
    """Rows of a sorted stream, with a mark where the region or sample changes."""
    last = None
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            key = (r.ord, r.sample)
            yield key != last, r
            last = key


def _body_kernel(min_fibers: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}

        def close() -> pd.DataFrame | None:
            if not state or state["n"] < min_fibers:
                return None
            left, size = state["left"], state["size"]
            nuc, met = state["nuc"].mean(), state["met"].mean()
            body_nuc, body_met = nuc[left : left + size], met[left : left + size]
            parts = lambda v: np.r_[resize(v[:left], FLANK_BINS), resize(v[left : left + size], METAPLOT_BODY_BINS), resize(v[left + size :], FLANK_BINS)]
            bins = state["bins"]
            return pd.DataFrame(
                [[state["ord"], state["sample"], state["n"], (resize(body_nuc, bins)), (resize(smooth(body_met), bins)), (parts(nuc)), (parts(met)), _mean(body_nuc), _mean(body_met)]],
                columns=["ord", "sample", "n_fibers", "nuc_body", "met_body", "nuc_meta", "met_meta", "mean_nuc_occupancy", "mean_methylation"],
            )

        for new, r in _streamed(batches):
            if new:
                done = close()
                if done is not None:
                    yield done
                low = max(r.rs - r.flank, 0)
                n = r.re + r.flank - low
                state = {"ord": r.ord, "sample": r.sample, "n": 0, "low": low, "length": n, "left": r.rs - low, "size": r.re - r.rs, "bins": r.bins, "nuc": _Sum(n), "met": _Sum(n)}
            state["n"] += 1
            state["nuc"].add(occupancy(r.nuc_a, r.nuc_b, state["low"], state["length"], (r.fs, r.fe)))
            state["met"].add(methylation(r.met_a, r.met_v, state["low"], state["length"], (r.fs, r.fe)))
        done = close()
        if done is not None:
            yield done

    return run


def _kernel_tasks(df: DataFrame) -> int:
    """Tasks of a kernel stage: as many as a shuffle has. Given as a number, AQE doesn't join them by their few bytes, as a kernel's work is not its input's size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _check(regions: DataFrame, annotations: list[str]) -> None:
    known = {r[0] for r in regions.where(F.col("annotation").isin(annotations)).select("annotation").distinct().collect()}
    if unknown := [a for a in annotations if a not in known]:
        raise ValueError(f"unknown annotation {unknown[0]!r}")


def first_regions(regions: DataFrame, annotations: list[str], max_regions: int | None) -> DataFrame:
    rows = regions.where(F.col("annotation").isin(annotations))
    if max_regions is not None:
        w = Window.partitionBy("annotation").orderBy("ord")
        rows = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max_regions).drop("_k")
    return rows


def _by_type(values: dict[str, int], default: int | None) -> Column:
    out = F.lit(default).cast("long")
    for k, v in values.items():
        out = F.when(F.col("annotation") == k, F.lit(v).cast("long")).otherwise(out)
    return out


def annotation_matrices(regions: DataFrame, fibers: DataFrame, layers: dict[str, DataFrame], annotations: list[str], max_regions: int | None = None, min_fiber_coverage: float = MIN_FIBER_COVERAGE, min_fibers: int = MIN_FIBERS, max_region_bp: int = MAX_REGION_BP, flank_bp: int = FLANK_BP) -> DataFrame:
    """Body and meta-profile vectors of each region and sample with at least ``min_fibers`` spanning fibers.

    Regions that are empty or longer than ``max_region_bp`` are left out; the left flank ends at the chromosome's start. NaN
    is null in the result. An unknown annotation raises.
    """
    _check(regions, annotations)
    size = F.col("end") - F.col("start")
    rows = first_regions(regions, annotations, max_regions).where((size >= 1) & (size <= max_region_bp)).withColumn("bins", _by_type(BODY_BINS, DEFAULT_BODY_BINS))
    joined = region_fibers(rows, fibers, layers, min_fiber_coverage, F.lit(flank_bp))
    bins = rows.select(F.col("ord").alias("_o"), "bins", F.col("annotation"), F.col("id").alias("region_id"))
    spread = joined.join(broadcast_if_small(bins.select("_o", "bins"), []), F.col("ord") == F.col("_o")).drop("_o")
    out = spread.repartition(_kernel_tasks(regions), "ord", "sample").sortWithinPartitions("ord", "sample", "fiber_int_id").mapInPandas(_body_kernel(min_fibers), _MATRIX)
    out = _without_nan(out, "nuc_body", "met_body", "nuc_meta", "met_meta")
    return out.join(broadcast_if_small(bins.select("_o", "annotation", "region_id"), ["annotation", "region_id"]), F.col("ord") == F.col("_o")).drop("_o")


def region_centers(regions: DataFrame, strands: DataFrame | None = None) -> DataFrame:
    """Regions with ``center``, ``strand`` and ``gene``: a promoter's inner point, else the middle.

    ``strands`` has chrom, start, end, id, strand (1, -1, 0), gene, one row a region; regions without direction have 0 and '.'.
    """
    directional = F.col("annotation").isin(*PROMOTER_TYPES, *GENEBODY_TYPES)
    if strands is not None:
        s = strands.groupBy(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("id").alias("_i")).agg(F.max(F.struct("strand", "gene")).alias("_d"))
        on = (F.col("chrom") == F.col("_c")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")) & (F.col("id") == F.col("_i"))
        rows = regions.join(broadcast_if_small(s, ["_c", "_i"]), on, "left")
        strand, gene = F.coalesce(F.when(directional, F.col("_d.strand")), F.lit(0)), F.coalesce(F.when(directional, F.col("_d.gene")), F.lit("."))
    else:
        rows, strand, gene = regions, F.lit(0), F.lit(".")
    rows = rows.withColumn("strand", strand.cast("int")).withColumn("gene", gene)
    inner = F.when(F.col("strand") == -1, F.col("end") - 500).otherwise(F.col("start") + 500)
    center = F.when(F.col("annotation").isin(*PROMOTER_TYPES), inner).otherwise(F.floor((F.col("start") + F.col("end")) / 2).cast("long"))
    return rows.withColumn("center", center).select(*regions.columns, "strand", "gene", "center")


_CENTERED = "ord long, sample string, n_fibers long, nuc array<double>, met array<double>, met_binned array<double>, mean_nuc_occupancy double, mean_methylation double"


def _centered_kernel(min_fibers: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state: dict = {}

        def close() -> pd.DataFrame | None:
            if not state or state["n"] < min_fibers:
                return None
            nuc, raw = state["nuc"].mean(), state["met"].mean()
            met, binned = smooth(raw), state["bins"].mean()
            if state["back"]:
                nuc, met, binned = nuc[::-1], met[::-1], binned[::-1]
            return pd.DataFrame([[state["ord"], state["sample"], state["n"], (nuc), (met), (binned), _mean(nuc), _mean(raw)]], columns=["ord", "sample", "n_fibers", "nuc", "met", "met_binned", "mean_nuc_occupancy", "mean_methylation"])

        for new, r in _streamed(batches):
            if new:
                done = close()
                if done is not None:
                    yield done
                n = 2 * r.extension
                state = {"ord": r.ord, "sample": r.sample, "n": 0, "low": r.center - r.extension, "length": n, "back": r.strand == -1, "nuc": _Sum(n), "met": _Sum(n), "bins": _Sum(max(1, n // BIN_SIZE))}
            state["n"] += 1
            state["nuc"].add(occupancy(r.nuc_a, r.nuc_b, state["low"], state["length"], (r.fs, r.fe)))
            vector = methylation(r.met_a, r.met_v, state["low"], state["length"], (r.fs, r.fe))
            state["met"].add(vector)
            state["bins"].add(binned_methylation([vector], state["length"]))
        done = close()
        if done is not None:
            yield done

    return run


def centered_matrices(regions: DataFrame, fibers: DataFrame, layers: dict[str, DataFrame], annotations: list[str], strands: DataFrame | None = None, max_regions: int | None = None, min_fiber_coverage: float = MIN_FIBER_COVERAGE, min_fibers: int = MIN_FIBERS, extension: dict[str, int] | None = None) -> DataFrame:
    """Vectors of a window about each region's center, by sample; those of minus-strand regions are turned round.

    Fibers are chosen by their coverage of the region, not of the window. A window that begins before the chromosome is left
    out; a type without a known extension raises.
    """
    extension = EXTENSION if extension is None else extension
    _check(regions, annotations)
    if unknown := [a for a in annotations if a not in extension]:
        raise ValueError(f"no window is known for annotation {unknown[0]!r}")
    rows = region_centers(first_regions(regions, annotations, max_regions), strands).withColumn("extension", _by_type(extension, None))
    rows = rows.where((F.col("center") - F.col("extension") >= 0) & (F.col("end") > F.col("start")))
    joined = region_fibers(rows, fibers, layers, min_fiber_coverage, F.col("extension") * 2)
    place = rows.select(F.col("ord").alias("_o"), "center", "extension", "strand")
    spread = joined.join(broadcast_if_small(place, []), F.col("ord") == F.col("_o")).drop("_o")
    out = spread.repartition(_kernel_tasks(regions), "ord", "sample").sortWithinPartitions("ord", "sample", "fiber_int_id").mapInPandas(_centered_kernel(min_fibers), _CENTERED)
    out = _without_nan(out, "nuc", "met", "met_binned")
    named = rows.select(F.col("ord").alias("_o"), "annotation", F.col("id").alias("region_id"), "chrom", "start", "end", "center", "strand", "gene")
    return out.join(broadcast_if_small(named, ["annotation", "region_id", "gene"]), F.col("ord") == F.col("_o")).drop("_o").orderBy(F.col("mean_nuc_occupancy").desc_nulls_last(), "ord", "sample")


def metaplot(matrices: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Mean of a vector column by place, over the rows of each group; nulls are no values."""
    return matrices.select(*keys, F.posexplode(vector).alias("place", "v")).groupBy(*keys, "place").agg(F.avg("v").alias("mean"))


def occupancy_profile(regions: DataFrame, fibers: DataFrame, nucleosomes: DataFrame) -> DataFrame:
    """Bases of intervals in each region, by place from its start, over the fibers that meet it (long form, JVM only).

    ord, place, ``covered`` = fibers with an interval over the base. An interval counts once a fiber and base.
    """
    spans = spanning_fibers(fibers, regions, 0.0).select("ord", "sample", "chrom", "fiber_int_id", "fs", "fe", "rs", "re")
    n = nucleosomes.select(*[F.col(k).alias(f"c_{k}") for k in ("sample", "chrom", "fiber_int_id")], F.col("start").alias("a"), F.col("end").alias("b"))
    on = [F.col(k) == F.col(f"c_{k}") for k in ("sample", "chrom", "fiber_int_id")] + [F.col("b") > F.col("rs"), F.col("a") < F.col("re")]
    hit = spans.join(n, on).select("ord", "sample", "fiber_int_id", (F.greatest("a", "rs") - F.col("rs")).alias("lo"), (F.least("b", "re") - F.col("rs")).alias("hi")).where("hi > lo")
    # what an interval adds to those before it on its fiber; then only where a region's depth changes is a row
    w = Window.partitionBy("ord", "sample", "fiber_int_id").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    added = hit.withColumn("lo", F.greatest("lo", F.max("hi").over(w))).where("hi > lo")
    step = lambda c, by: F.struct(F.col(c).alias("place"), F.lit(by).alias("by"))
    steps = added.select("ord", F.inline(F.array(step("lo", 1), step("hi", -1)))).groupBy("ord", "place").agg(F.sum("by").alias("by"))
    along = Window.partitionBy("ord").orderBy("place")
    depth = steps.select("ord", "place", F.sum("by").over(along).alias("covered"), F.lead("place").over(along).alias("until")).where("covered > 0")
    return depth.select("ord", F.explode(F.sequence("place", F.col("until") - 1)).alias("place"), "covered")


def methylation_bins(regions: DataFrame, fibers: DataFrame, m5c: DataFrame, size: int = BIN_SIZE) -> DataFrame:
    """Mean over fibers of each fiber's methylated share in bins of a region: ord, bin, ``mean_methylation`` (JVM only)."""
    spans = spanning_fibers(fibers, regions, 0.0).select("ord", "sample", "chrom", "fiber_int_id", "rs", "re", "fs", "fe")
    called = is_call(m5c)
    c = m5c.where(called.isNotNull()).select(*[F.col(k).alias(f"c_{k}") for k in ("sample", "chrom", "fiber_int_id")], "pos", called.cast("double").alias("v"))
    on = [F.col(k) == F.col(f"c_{k}") for k in ("sample", "chrom", "fiber_int_id")] + [F.col("pos") >= F.col("rs"), F.col("pos") < F.col("re"), F.col("pos") >= F.col("fs"), F.col("pos") < F.col("fe")]
    per = spans.join(c, on).withColumn("bin", F.floor((F.col("pos") - F.col("rs")) / size)).groupBy("ord", "sample", "fiber_int_id", "bin").agg(F.avg("v").alias("v"))
    return per.groupBy("ord", "bin").agg(F.avg("v").alias("mean_methylation"))
