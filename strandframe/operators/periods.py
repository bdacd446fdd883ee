"""Continuous periods of an entity's spans, and the gaps between them.

The aggregate state of an (entity, bucket) is a sorted list of disjoint intervals. Map tasks build
one per Arrow batch, a shuffle brings the lists of a bucket together, and each reducer combines them
by a linear merge of sorted lists. An entity is cut by start position into buckets, so that no task holds a whole hot
entity: a bucket's list has at most ``bucket_width`` entries, whatever the number of rows. The next
level of the tree combines buckets through one small row each (start of the last interval, largest
end); only that row is windowed per entity, and its result says which period is open on entering a
bucket and where the covered part ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import broadcast_if_small, checkpointed

#: Positions per bucket. A fiber of ordinary length falls in one or two.
BUCKET_WIDTH = 1 << 17


def _merge_sorted(group: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Disjoint stretches (touching ones joined) of spans sorted by group and start."""
    if not len(group):
        return group, start, end
    low = int(end.min())
    span = int(end.max()) - low + 1
    if int(group[-1] + 1) * span < 1 << 62:
        reach = np.maximum.accumulate(group * span + (end - low)) - group * span + low
    else:
        reach = end.copy()
        cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(group)], strict=True):
            np.maximum.accumulate(end[a:b], out=reach[a:b])
    first = np.r_[True, (group[1:] != group[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(first)
    return group[at], start[at], reach[np.r_[at[1:] - 1, len(group) - 1]]


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Index of the first row of each run of equal keys in sorted rows."""
    n = len(columns[0])
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for c in columns:
        codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(change)


def _lists(keys: list[pa.Array], names: list[str], head: np.ndarray, group: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """One row per group: its keys, its list of intervals, the last start and the largest end."""
    counts = np.bincount(group, minlength=len(head))
    offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
    last = np.cumsum(counts) - 1
    arrays = [k.take(pa.array(head)) for k in keys] + [
        pa.ListArray.from_arrays(offsets, pa.array(start)),
        pa.ListArray.from_arrays(offsets, pa.array(end)),
        pa.array(start[last]),
        pa.array(end[last]),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "starts", "ends", "last_start", "max_end"])


def _partial(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(n) for n in names]
            codes = [k.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) for k in keys]
            start = batch.column("s").to_numpy(zero_copy_only=False)
            end = batch.column("e").to_numpy(zero_copy_only=False)
            order = np.lexsort([start, *codes])
            change = np.zeros(len(order), dtype=bool)
            change[0] = True
            for c in codes:
                d = c[order]
                change[1:] |= d[1:] != d[:-1]
            group = np.cumsum(change) - 1
            yield _lists(keys, names, order[np.flatnonzero(change)], *_merge_sorted(group, start[order], end[order]))

    return run


def _merged_order(group: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The order of entries by group and start, where each group holds sorted lists one behind the other.

    Both are folded into one integer, in which the lists are ascending runs, and a stable sort of integers is a
    merge of the runs it finds (timsort): pairs of lists are merged linearly, and the results again, as a tree.
    """
    low = int(start.min()) if len(start) else 0
    span = int(start.max()) - low + 1 if len(start) else 1
    if len(start) and int(group[-1] + 1) * span >= 1 << 62:
        return np.lexsort([start, group])
    return np.argsort(group * span + (start - low), kind="stable")


def _combine(names: list[str]):
    def merge(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(n).combine_chunks() for n in names]
        head = _runs(keys)
        sizes = pa.compute.list_value_length(table.column("starts")).to_numpy()
        of_row = np.cumsum(np.bincount(head, minlength=table.num_rows)) - 1
        group = np.repeat(of_row, sizes)
        start = pa.compute.list_flatten(table.column("starts")).to_numpy()
        end = pa.compute.list_flatten(table.column("ends")).to_numpy()
        if len(head) < table.num_rows:
            order = _merged_order(group, start)
            group, start, end = _merge_sorted(group[order], start[order], end[order])
        return _lists(keys, names, head, group, start, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        kept: pa.Table | None = None  # the merged list of the bucket that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([kept, table]) if kept is not None else table
            merged = merge(table)
            if merged.num_rows > 1:
                yield merged.slice(0, merged.num_rows - 1)
            kept = pa.Table.from_batches([merged.slice(merged.num_rows - 1)])
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return run


def _emit(names: list[str]):
    """Periods and gaps of buckets whose open period is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = pc.list_value_length(batch.column("starts")).to_numpy()
            row = np.repeat(np.arange(batch.num_rows), sizes)
            start = pc.list_flatten(batch.column("starts")).to_numpy()
            end = pc.list_flatten(batch.column("ends")).to_numpy()
            opened = batch.column("open_start").is_valid().to_numpy(zero_copy_only=False)
            open_start = batch.column("open_start").fill_null(0).to_numpy(zero_copy_only=False)
            open_end = batch.column("open_end").fill_null(0).to_numpy(zero_copy_only=False)
            final = batch.column("final").to_numpy(zero_copy_only=False)
            first = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
            before = np.r_[0, end[:-1]] if len(row) else end
            # where the covered part ends before each interval, and whether there is any
            covered = np.where(first, open_end[row], np.where(opened[row], np.maximum(before, open_end[row]), before))
            any_before = ~first | opened[row]
            new = ~any_before | (start > covered)
            at = np.flatnonzero(new)
            r, s, c, has = row[at], start[at], covered[at], any_before[at]
            head = np.r_[True, r[1:] != r[:-1]] if len(at) else np.zeros(0, bool)
            previous = np.where(head, open_start[r], np.r_[0, s[:-1]]) if len(at) else s
            # the period still open behind the last bucket of an entity
            lastrow = np.flatnonzero(final)
            last_new = np.full(batch.num_rows, -1)
            last_new[r] = np.arange(len(at))
            tail = last_new[lastrow]
            tail_start = np.where(tail >= 0, s[tail] if len(s) else 0, open_start[lastrow])
            max_end = batch.column("max_end").to_numpy()
            tail_end = np.where(opened[lastrow], np.maximum(max_end[lastrow], open_end[lastrow]), max_end[lastrow])
            rows = np.r_[r[has], r[has], lastrow]
            kinds = pa.array(np.repeat(["period", "gap", "period"], [has.sum(), has.sum(), len(lastrow)]))
            yield pa.RecordBatch.from_arrays(
                [kinds.cast(pa.string())]
                + [batch.column(n).take(pa.array(rows)) for n in names]
                + [pa.array(np.r_[previous[has], c[has], tail_start].astype(np.int64)), pa.array(np.r_[c[has], s[has], tail_end].astype(np.int64))],
                names=["kind", *names, "from_pos", "to_pos"],
            )

    return run


def merged_periods(spans: DataFrame, keys: list[str], start: str | Column, end: str | Column, bucket_width: int = BUCKET_WIDTH) -> DataFrame:
    """Maximal covered stretches of each entity and the gaps between neighbours.

    Returns ``kind`` ('period' or 'gap'), the keys, ``from_pos`` and ``to_pos``. Spans are half-open
    and touching spans are one stretch. Left out: rows with a null key, start or end, and rows with
    end <= start. Repeated and nested rows change nothing. An entity without a usable row gives no
    row; an empty input gives an empty result. Other columns are ignored, whatever their names.
    """
    start = F.col(start) if isinstance(start, str) else start
    end = F.col(end) if isinstance(end, str) else end
    # columns are renamed, so that no key can clash with the operator's own names
    inner = [f"k{i}" for i in range(len(keys))]
    rows = spans.select(*[F.col(k).alias(n) for k, n in zip(keys, inner, strict=True)], start.cast("long").alias("s"), end.cast("long").alias("e"))
    types = dict(rows.dtypes)
    rows = rows.where(" and ".join(f"{n} is not null" for n in inner) + " and s is not null and e is not null and e > s")
    rows = rows.withColumn("bucket", F.floor(F.col("s") / F.lit(bucket_width)).cast("long"))
    names = [*inner, "bucket"]
    state = ", ".join(f"{n} {types[n]}" for n in inner) + ", bucket long, starts array<long>, ends array<long>, last_start long, max_end long"
    # the lists are read twice, for their edges and for their intervals, so they are kept
    lists = checkpointed(
        rows.mapInArrow(_partial(names), state)
        .repartition(*names)
        .sortWithinPartitions(*names)
        .mapInArrow(_combine(names), state)
    )
    order = Window.partitionBy(*inner).orderBy("bucket")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        lists.select(*names, "last_start", "max_end")
        .withColumn("open_end", F.max("max_end").over(earlier))
        .withColumn("opens", F.when(F.col("open_end").isNull() | (F.col("last_start") > F.col("open_end")), F.col("last_start")))
        .withColumn("open_start", F.last("opens", ignorenulls=True).over(earlier))
        .withColumn("later", F.lead("bucket").over(order).isNotNull())
        .where("open_end is not null or later")
        .select(*[F.col(n).alias(f"e_{n}") for n in names], "open_start", "open_end", "later")
    )
    edges = broadcast_if_small(edges, [])
    joined = lists.join(edges, [lists[n] == edges[f"e_{n}"] for n in names], "left")
    out = joined.select(*inner, "starts", "ends", "max_end", "open_start", "open_end", (~F.coalesce("later", F.lit(False))).alias("final"))
    schema = "kind string, " + ", ".join(f"{n} {types[n]}" for n in inner) + ", from_pos long, to_pos long"
    return out.mapInArrow(_emit(inner), schema).toDF("kind", *keys, "from_pos", "to_pos")
