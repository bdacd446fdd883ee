"""Items that occur together in baskets, and how much more often than chance.

Pairs of a basket are packed into 64-bit codes (beside a second code for the upper halves, which is 0 up
to 2^32 items). A task sorts and run-length counts the codes of each Arrow batch, so that what is shuffled
is a sorted run of (code, count); Spark's sort spills such runs and merges them, and one more run-length
count over the merged order gives the totals. The items of a group that has many are dealt into chunks; a
basket is one row a chunk, and what is paired is a chunk with itself or with another, each in a row of its
own, so no basket is gathered and its pairs are made by many tasks. Equal baskets are counted first, so a
basket that a third of all rows share is cut into pairs once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import broadcast_if_small, checkpointed

#: Pair codes held at once in a task.
CODES_AT_ONCE = 1 << 20
#: Items of a group for each chunk: a row holds about as many codes of a basket at most.
ITEMS_PER_CHUNK = 4096


def _count_runs(upper: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes in order, with their summed counts."""
    order = np.lexsort([codes, upper]) if upper.any() else np.argsort(codes, kind="stable")
    return _run_lengths(upper[order], codes[order], counts[order])


def _run_lengths(upper: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(codes):
        return upper, codes, counts
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (upper[1:] != upper[:-1])])
    return upper[first], codes[first], np.add.reduceat(counts, first)


def _packed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The upper and the lower halves of two item numbers, each pair of halves in 64 bits."""
    low = np.int64((1 << 32) - 1)
    return ((a >> 32) << 32) | (b >> 32), (a << 32) | (b & low)


def _batch(upper: np.ndarray, codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(upper), pa.array(codes), pa.array(counts)], names=["upper", "code", "n"])


_CODES = "upper long, code long, n long"


class _Held:
    """Pair codes of a task that wait to be counted."""

    def __init__(self) -> None:
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        self._parts.append((*_packed(a, b), counts))
        self._n += len(counts)
        if self._n >= CODES_AT_ONCE:
            yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        if self._parts:
            yield _batch(*_count_runs(*(np.concatenate([p[i] for p in self._parts]) for i in range(3))))
        self._parts, self._n = [], 0


def _pair_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within each row's items."""
    import pyarrow.compute as pc

    held = _Held()
    for batch in batches:
        sizes = pc.list_value_length(batch.column("items")).to_numpy()
        flat = pc.list_flatten(batch.column("items")).to_numpy()
        start = np.cumsum(sizes) - sizes
        weight = batch.column("weight").to_numpy()
        for size in np.unique(sizes[sizes > 1]).tolist():
            rows = np.flatnonzero(sizes == size)
            # a step is so many baskets, or so many first items of one large basket
            baskets = max(1, CODES_AT_ONCE // (size * (size - 1) // 2))
            firsts = size if baskets > 1 else max(1, CODES_AT_ONCE // size)
            for at in range(0, len(rows), baskets):
                r = rows[at : at + baskets]
                block = flat[start[r][:, None] + np.arange(size)]
                for low in range(0, size, firsts):
                    i, j = _block_pairs(size, low, min(low + firsts, size))
                    yield from held.add(block[:, i].ravel(), block[:, j].ravel(), np.repeat(weight[r], len(i)))
        yield from held.out()


def _cross_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of an item of each row's first chunk and one of its second."""
    held = _Held()
    for batch in batches:
        for first, second in zip(batch.column("items"), batch.column("others"), strict=True):
            x, y = first.values.to_numpy(), second.values.to_numpy()
            step = max(1, CODES_AT_ONCE // max(1, len(y)))
            for low in range(0, len(x), step):
                a, b = np.repeat(x[low : low + step], len(y)), np.tile(y, len(x[low : low + step]))
                yield from held.add(np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64))
        yield from held.out()


def _block_pairs(size: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) with i in [low, high) and j > i."""
    i, j = np.nonzero(np.arange(size)[None, :] > np.arange(low, high)[:, None])
    return i + low, j


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length count over codes that arrive in order."""
    last: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        runs = [batch.column(i).to_numpy() for i in range(3)]
        if last is not None:
            runs = [np.r_[x, y] for x, y in zip(last, runs, strict=True)]
        runs = _run_lengths(*runs)
        last = tuple(x[-1:] for x in runs)
        if len(runs[0]) > 1:
            yield _batch(*(x[:-1] for x in runs))
    if last is not None:
        yield _batch(*last)


def _numbered(distinct: DataFrame, order: list[str]) -> DataFrame:
    """A dense number 0, 1, ... for each row, without gathering the rows: counts by partition are summed on the driver."""
    pinned = checkpointed(distinct.withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in pinned.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, total))
        total += sizes[part]
    offsets = distinct.sparkSession.createDataFrame(rows or [(0, 0)], "_of int, _offset long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return pinned.withColumn("_n", within).join(F.broadcast(offsets), F.col("_part") == F.col("_of")).withColumn("code", F.col("_n") + F.col("_offset")).drop("_part", "_of", "_n", "_offset")


def _chunk_pairs(baskets: DataFrame) -> DataFrame:
    """Each two chunks of a basket in one row (``items``, ``others``), however many chunks it has."""
    at = baskets.select("grp", "basket", "items", "chunk", F.explode(F.expr("sequence(0L, n_chunks - 1)")).alias("other")).where("chunk <> other")
    keyed = at.select("grp", "basket", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "items", (F.col("chunk") < F.col("other")).alias("first"))
    others = keyed.where(~F.col("first")).select("grp", "basket", "low", "high", F.col("items").alias("others"))
    return keyed.where("first").join(others, ["grp", "basket", "low", "high"]).select("items", "others")


def pair_counts(rows: DataFrame) -> DataFrame:
    """Co-occurrence of items within the groups of ``rows``: grp, item, basket (all text).

    Returns ``grp, item_a, item_b, n_ab, n_a, n_b, n``: distinct baskets of the group that hold both items, each
    of them, and any item; item_a < item_b as text; pairs that never meet have no row. ``lift`` is n_ab * n / (n_a * n_b)
    and ``odds_ratio`` has 0.5 added to each cell. Rows with a null group, item or basket are left out and
    repeated rows count once; blank text is a value like others. An item that is alone in its baskets has no pair; an empty
    input gives an empty result. No basket, item or pair is dropped for its size.
    """
    rows = rows.select("grp", "item", "basket").where("grp is not null and item is not null and basket is not null")
    items = _numbered(rows.select("grp", "item").distinct(), ["grp", "item"])
    chunks = items.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / ITEMS_PER_CHUNK).cast("long").alias("n_chunks"))
    many = (chunks.agg(F.max("n_chunks")).first()[0] or 0) > 1
    one = F.lit(1).cast("long")
    placed = items.join(broadcast_if_small(chunks, ["grp"]), "grp") if many else items.withColumn("n_chunks", one)
    placed = placed.withColumn("chunk", F.pmod("code", "n_chunks"))
    coded = rows.join(broadcast_if_small(placed, ["grp", "item"]), ["grp", "item"]).select("grp", "basket", "chunk", "n_chunks", "code")
    baskets = coded.groupBy("grp", "basket", "chunk", "n_chunks").agg(F.array_sort(F.collect_set("code")).alias("items"))
    baskets = checkpointed(baskets) if many else baskets
    alike = checkpointed(baskets.groupBy("grp", "n_chunks", "items").agg(F.count(F.lit(1)).alias("weight")))
    # a basket of a group of one chunk is one row; of the others the distinct baskets are counted
    n = alike.where("n_chunks = 1").groupBy("grp").agg(F.sum("weight").alias("n"))
    single = alike.select("weight", F.explode("items").alias("code")).groupBy("code").agg(F.sum("weight").alias("n_item"))
    found = alike.select("items", "weight").mapInArrow(_pair_codes, _CODES)
    if many:
        n = n.unionByName(baskets.where("n_chunks > 1").select("grp", "basket").distinct().groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
        found = found.unionByName(_chunk_pairs(baskets.where("n_chunks > 1")).mapInArrow(_cross_codes, _CODES))
    half = lambda c, up: F.shiftrightunsigned(c, 32) if up else F.col(c).bitwiseAND((1 << 32) - 1)
    # codes follow no order of the texts, so a pair's texts are put in order at the end
    pairs = (
        found.repartition("upper", "code")
        .sortWithinPartitions("upper", "code")
        .mapInArrow(_merge_runs, _CODES)
        .select(*[F.shiftleft(half("upper", up), 32).bitwiseOR(half("code", up)).alias(name) for name, up in (("code_a", True), ("code_b", False))], F.col("n").alias("n_ab"))
    )
    known = broadcast_if_small(checkpointed(items.join(single, "code")), ["grp", "item"])
    a = known.select(F.col("code").alias("code_a"), "grp", F.col("item").alias("x"), F.col("n_item").alias("n_x"))
    b = known.select(F.col("code").alias("code_b"), F.col("item").alias("y"), F.col("n_item").alias("n_y"))
    joined = pairs.join(a, "code_a").join(b, "code_b").join(broadcast_if_small(n, ["grp"]), "grp")
    swap = F.col("x") > F.col("y")
    out = joined.select(
        "grp",
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("item_a"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("item_b"),
        "n_ab",
        F.when(swap, F.col("n_y")).otherwise(F.col("n_x")).alias("n_a"),
        F.when(swap, F.col("n_x")).otherwise(F.col("n_y")).alias("n_b"),
        "n",
    )
    only_a, only_b = F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    neither = F.col("n") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    half = 0.5  # the continuity correction
    return out.withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))).withColumn(
        "odds_ratio", (F.col("n_ab") + half) * (neither + half) / ((only_a + half) * (only_b + half))
    )
