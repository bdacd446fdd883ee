"""Numbers and running totals over a whole order, without a task that sees all rows.

Rows are brought into range partitions, which are kept; only one number a partition comes to the driver, as the
place where the partition begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import broadcast_if_small, checkpointed

_ROW_BITS = 33


def _begins(sums: dict[int, int]) -> list[tuple[int, int]]:
    out, total = [], 0
    for part in sorted(sums):
        out.append((part, total))
        total += sums[part]
    return out or [(0, 0)]


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with the numbers 0, 1, ... of the order as ``name``; rows that are equal in it are numbered as they come."""
    # a kept partition's rows are read in their order, and the row's place is the lower part of its id
    pinned = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_place", F.monotonically_increasing_id())
    part = F.shiftright("_place", _ROW_BITS)
    sizes = {r.p: r.n for r in pinned.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    begins = rows.sparkSession.createDataFrame(_begins(sizes), "_part long, _begin long")
    placed = pinned.join(F.broadcast(begins), part == F.col("_part"))  # a row a partition
    return placed.withColumn(name, F.col("_begin") + F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_place", "_part", "_begin")


def numbered_within(rows: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with the numbers 0, 1, ... of the order within each group, however large one is."""
    all_rows = numbered(rows, [*within, *order], "_n")
    first = all_rows.groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)]).agg(F.min("_n").alias("_first"))
    first = broadcast_if_small(first, [f"_g{i}" for i in range(len(within))])
    same = F.lit(True)
    for i, c in enumerate(within):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return all_rows.join(first, same).withColumn(name, F.col("_n") - F.col("_first")).drop("_n", "_first", *[f"_g{i}" for i in range(len(within))])


def running_total(rows: DataFrame, order: list[str], amount: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``amount`` up to and with each row as ``name``; rows differ in ``order``."""
    pinned = checkpointed(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = {r["_part"]: r.n for r in pinned.groupBy("_part").agg(F.sum(amount).alias("n")).collect()}
    begins = rows.sparkSession.createDataFrame(_begins(sums), "_of int, _begin long")
    within = F.sum(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    out = pinned.withColumn("_within", within).join(F.broadcast(begins), F.col("_part") == F.col("_of"))
    return out.withColumn(name, F.col("_begin") + F.col("_within")).drop("_part", "_of", "_begin", "_within")
