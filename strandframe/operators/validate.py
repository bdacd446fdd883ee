"""Agreement of two rankings, and order-free fingerprints of rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.ordering import running_total
from strandframe.session import checkpointed

TOP_K = (10, 50, 100, 500, 1000, 5000, 10_000, 50_000)


def canonical_pairs(pairs: DataFrame, a: str, b: str, value: str, order: str, tolerance: float = 1e-9) -> DataFrame:
    """One row an unordered pair (key_a <= key_b), the first by ``order``; raises where listings of a pair disagree in ``value``.

    A pair of two nulls in value agrees. Rows with a null element are left out.
    """
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("key_a", F.least(a, b)).withColumn("key_b", F.greatest(a, b))
    per = rows.groupBy("key_a", "key_b").agg(F.min_by(F.struct(*[c for c in rows.columns if c not in ("key_a", "key_b")]), order).alias("r"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("n_listed"))
    agree = F.coalesce((F.col("_hi") - F.col("_lo")) <= tolerance * F.greatest(F.abs("_lo"), F.abs("_hi")), F.lit(True))
    checked = F.when(agree, True).otherwise(F.raise_error(F.concat(F.lit("listings disagree for "), F.col("key_a"), F.lit(" and "), F.col("key_b"))).cast("boolean"))
    return per.where(checked).select("key_a", "key_b", "r.*", "n_listed")


def membership(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with status 'shared', 'left_only' or 'right_only'."""
    a, b = left.select(*keys, F.lit(1).alias("_a")).distinct(), right.select(*keys, F.lit(1).alias("_b")).distinct()
    both = a.join(b, keys, "full_outer")
    status = F.when(F.col("_a").isNull(), "right_only").when(F.col("_b").isNull(), "left_only").otherwise("shared")
    return both.select(*keys, status.alias("status"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation; null for fewer than two rows or a constant side."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((F.count(x) > 1) & (sx > 0) & (sy > 0), F.try_divide(F.covar_pop(x, y), sx * sy))


def average_ranks(rows: DataFrame, value: str, out: str) -> DataFrame:
    """Rows with the mean rank of equal values: values are counted, and only the distinct ones are put in order."""
    per = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranks = running_total(per, ["_v"], "_n", "_upto").select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(out))
    return rows.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def correlations(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """``n``, ``pearson`` and ``spearman`` of two columns, over rows that have both."""
    rows = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    rows = checkpointed(rows)  # each ranking reads them twice
    ranked = average_ranks(average_ranks(rows, "x", "rx"), "y", "ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("pearson"), pearson(F.col("rx"), F.col("ry")).alias("spearman"))


def confusion(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Counts of two yes/no columns and the share of rows in which they agree."""
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    a, b = F.col(left), F.col(right)
    out = pairs.agg(n(a & b, "both"), n(a & ~b, "left_only"), n(~a & b, "right_only"), n(~a & ~b, "neither"))
    total = F.col("both") + F.col("left_only") + F.col("right_only") + F.col("neither")
    return out.withColumn("agreement", F.try_divide(F.col("both") + F.col("neither"), total))


def top_k_overlap(left: DataFrame, right: DataFrame, keys: list[str], rank: str, ks: tuple[int, ...] = TOP_K) -> DataFrame:
    """For each k the rows that both rankings have within their first k, k being capped by both sizes."""
    spark = left.sparkSession
    sizes = left.agg(F.count(F.lit(1)).alias("n_left")).join(right.agg(F.count(F.lit(1)).alias("n_right")), F.lit(True))
    asked = spark.createDataFrame([(k,) for k in ks], "k long").join(F.broadcast(sizes), F.lit(True)).withColumn("used_k", F.least("k", "n_left", "n_right"))
    worst = left.select(*keys, F.col(rank).alias("_l")).join(right.select(*keys, F.col(rank).alias("_r")), keys).select(F.greatest("_l", "_r").alias("worst")).where(F.col("worst") <= max(ks))
    counts = worst.groupBy("worst").agg(F.count(F.lit(1)).alias("n"))
    hits = asked.join(F.broadcast(counts), F.col("worst") <= F.col("used_k"), "left").groupBy("k", "used_k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("overlap"))
    return hits.withColumn("share", F.try_divide(F.col("overlap"), F.col("used_k")))


def half_jaccard() -> Column:
    """The sign of a cluster that only the new ranking has: twice the shared fibers equal the unshared ones."""
    return 2 * F.col("n_both") == F.col("n_only_b") + F.col("n_only_a")


def agreement(left: DataFrame, right: DataFrame, keys: list[str], left_name: str = "left", right_name: str = "right") -> DataFrame:
    """One row of how two rankings (keys, score, rank, is_super; one row a key) agree.

    Rows and keys of each, shared and unshared keys, Pearson and Spearman of scores, Spearman of ranks, and how the classes of
    shared keys coincide. Empty rankings have counts of 0 and null correlations.
    """
    a = left.select(*keys, F.struct("score", "rank", "is_super").alias("l"))
    b = right.select(*keys, F.struct("score", "rank", "is_super").alias("r"))
    both = checkpointed(a.join(b, keys, "full_outer"))
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    has_l, has_r = F.col("l").isNotNull(), F.col("r").isNotNull()
    counts = both.agg(n(has_l, f"{left_name}_rows"), n(has_r, f"{right_name}_rows"), n(has_l & has_r, "shared"), n(has_l & ~has_r, f"{left_name}_only"), n(has_r & ~has_l, f"{right_name}_only"))
    shared = both.where(has_l & has_r).select("l.*", F.col("r.score").alias("score_r"), F.col("r.rank").alias("rank_r"), F.col("r.is_super").alias("super_r"))
    scores = correlations(shared, "score", "score_r").select(F.col("pearson").alias("score_pearson"), F.col("spearman").alias("score_spearman"))
    ranks = correlations(shared, "rank", "rank_r").select(F.col("spearman").alias("rank_spearman"))
    classes = confusion(shared, "is_super", "super_r")
    classes = classes.select(*[F.col(c).alias(f"super_{c}") for c in classes.columns])
    return counts.join(scores).join(ranks).join(classes)  # each is one row


def unordered(pairs: DataFrame) -> DataFrame:
    """One row a pair of a region whichever way round it was listed: of several the best ranked."""
    key = [F.col("stitched_id"), F.least("element_a", "element_b").alias("key_a"), F.greatest("element_a", "element_b").alias("key_b")]
    return pairs.select(*key, F.struct("rank", "score", "is_super").alias("p")).groupBy("stitched_id", "key_a", "key_b").agg(F.min("p").alias("p")).select("stitched_id", "key_a", "key_b", "p.*")


def validation(pairs: tuple[DataFrame, DataFrame], clusters: tuple[DataFrame, DataFrame], coverage: tuple[DataFrame, DataFrame] | None = None, difference: DataFrame | None = None) -> dict:
    """How the results of an earlier run agree with those of a new one: a summary of numbers, and the tables behind it.

    ``pairs`` and ``clusters`` are each the earlier and the new ranking; ``coverage`` the lines of both coverage tables, of
    which the earlier may hold the lines of ``difference`` besides those of the new.
    """
    key = ["stitched_id", "key_a", "key_b"]
    old, new = (checkpointed(unordered(p)) for p in pairs)
    top = top_k_overlap(old, new, key, "rank")
    only_new = clusters[1].join(clusters[0].select("stitched_id"), "stitched_id", "left_anti")
    suspicious = only_new.where(half_jaccard()).count() if "n_both" in only_new.columns else 0
    out = {
        "pairs": agreement(old, new, key).first().asDict() | {"left_listed": pairs[0].count(), "right_listed": pairs[1].count()},
        "clusters": agreement(*clusters, ["stitched_id"]).first().asDict() | {"right_only_half_jaccard": suspicious},
        "top_k": [r.asDict() for r in top.orderBy("k").collect()],
        "tables": {"pair_membership": membership(old, new, key), "cluster_membership": membership(*[c.select("stitched_id") for c in clusters], ["stitched_id"]), "top_k_overlap": top},
    }
    if coverage is not None:
        a, b = (line_fingerprint(c) for c in coverage)
        out["coverage"] = {"left": a, "right": b, "equal": a == b}
        if difference is not None:
            out["coverage"]["right_and_difference_are_left"] = composes(a, b, line_fingerprint(difference))
    return out


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint: rows, exclusive-or and sum of a 64-bit hash of each row's columns."""
    h = F.xxhash64(*columns)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor_hash"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("sum_hash"))


def _line_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = x = s = 0
    for batch in batches:
        for line in batch.column(0).to_pylist():
            if line is not None:
                v = int.from_bytes(hashlib.blake2b(line.encode(), digest_size=16).digest(), "big")
                n, x, s = n + 1, x ^ v, (s + v) % (1 << 128)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([f"{x:032x}"]), pa.array([f"{s:032x}"])], names=["n", "x", "s"])


def line_fingerprint(lines: DataFrame, column: str = "value") -> tuple[int, str, str]:
    """Rows, xor and sum modulo 2^128 of 128-bit digests of lines; a task sends one row to the driver."""
    n = x = s = 0
    for r in lines.select(F.col(column).cast("string")).mapInArrow(_line_digests, "n long, x string, s string").collect():
        n, x, s = n + r.n, x ^ int(r.x, 16), (s + int(r.s, 16)) % (1 << 128)
    return n, f"{x:032x}", f"{s:032x}"


def composes(whole: tuple[int, str, str], part: tuple[int, str, str], rest: tuple[int, str, str]) -> bool:
    """Whether the lines of ``part`` and ``rest`` together are those of ``whole``."""
    return (
        whole[0] == part[0] + rest[0]
        and int(whole[1], 16) == int(part[1], 16) ^ int(rest[1], 16)
        and int(whole[2], 16) == (int(part[2], 16) + int(rest[2], 16)) % (1 << 128)
    )


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same rows as often, in any order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
