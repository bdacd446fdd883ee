"""Timed look-ups and queries, summarised, and the report of a build."""

from __future__ import annotations

import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.operators import access, annotate, intervals
from strandframe.operators.features import summary_statistics
from strandframe.operators.intervals import Overlap
from strandframe.sources.text import parse_gnu_time

SIZES_KB = (1, 10, 100, 1000)


def fiber_windows(fibers: DataFrame, sizes_kb: tuple[int, ...] = SIZES_KB, n_regions: int = 25, seed: int = 3365) -> list[tuple[int, str, int, int]]:
    """Windows centred on fibers drawn by a seeded order: (size_kb, chrom, start, end)."""
    drawn = annotate.sane_fibers(fibers).orderBy(F.xxhash64("chrom", "fiber_int_id", F.lit(seed)), "chrom", "fiber_int_id").limit(n_regions).collect()
    out = []
    for kb in sizes_kb:
        for r in drawn:
            low = max(0, (r.start + r.end) // 2 - kb * 500)
            out.append((kb, r.chrom, low, low + kb * 1000))
    return out


def region_speed(fibers: DataFrame, sample: str, sizes_kb: tuple[int, ...] = SIZES_KB, n_regions: int = 25, repeats: int = 3, seed: int = 3365) -> DataFrame:
    """Times of region look-ups by scan and by bin join; raises where the two count differently. The first look-up of a window is not timed."""
    spark: SparkSession = fibers.sparkSession
    own = fibers.where(F.col("sample") == sample).cache()
    rows = []
    for kb, chrom, start, end in fiber_windows(own, sizes_kb, n_regions, seed):
        region = spark.createDataFrame([(chrom, 0, start, end)], "chrom string, ord long, rs long, re long")
        f = annotate.sane_fibers(own).select("chrom", "fiber_int_id", F.col("start").alias("fs"), F.col("end").alias("fe"))
        scan = lambda c=chrom, a=start, b=end: access.fibers_at(own, c, a, b, sample).count()
        binned = lambda f=f, r=region: intervals.range_join(f, r, ["chrom"], Overlap.STRICT, broadcast=False).count()
        if (n := scan()) != binned():
            raise RuntimeError(f"the two ways count differently on {chrom}:{start}-{end}")
        for mode, run in (("scan", scan), ("binned", binned)):
            for k in range(repeats):
                began = time.perf_counter()
                run()
                rows.append((kb, mode, f"{chrom}:{start}-{end}", k, n, time.perf_counter() - began))
    own.unpersist()
    return spark.createDataFrame(rows, "size_kb int, mode string, region string, repeat int, n_fibers long, seconds double")


def annotation_speed(query, annotations: list[str], repeats: int = 3, warmups: int = 1, max_regions: int = 50) -> DataFrame:  # noqa: ANN001
    """Times of ``query(annotation, max_regions)`` for each type, after ``warmups`` untimed runs."""
    rows, spark = [], None
    for a in annotations:
        for k in range(-warmups, repeats):
            began = time.perf_counter()
            df = query(a, max_regions)
            n = df.count()
            spark = df.sparkSession
            if k >= 0:
                rows.append((a, k, n, time.perf_counter() - began))
    return spark.createDataFrame(rows, "annotation string, repeat int, n_rows long, seconds double")


def speed_summary(times: DataFrame, keys: list[str]) -> DataFrame:
    return summary_statistics(times, keys, "seconds")


def build_report(config_path: str | Path, resource_log: str | Path | None, elapsed_seconds: float, git_commit: str | None = None) -> dict:
    """What a build took, from its configuration and a GNU time report."""
    report: dict[str, object] = {"config": str(config_path), "elapsed_seconds": elapsed_seconds, "git_commit": git_commit}
    if resource_log is not None:
        entries = parse_gnu_time(resource_log)
        report["resources"] = entries
        rss = entries.get("Maximum resident set size (kbytes)")
        report["peak_rss_gb"] = round(float(rss) / 2**20, 3) if rss is not None else None
    return report


def percentile(values: list[float], share: float) -> float:
    return float(np.percentile(values, share * 100))
