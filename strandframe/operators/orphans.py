"""References whose parent was not there when they arrived.

Keys become integers: the digits of an id ("m84/1203/ccs") count within the text around them, a UUID is
its 128 bits, any other text a 128-bit hash. The parents' sorted integers are compressed into contiguous
runs, and so is each parent's live time into runs of (integer, microsecond). Runs and references are
brought into one order by a range exchange, in which every reference is matched as-of to the run that
starts at or before it: a reference beyond the end of the preceding run of keys is to no parent at all,
one beyond the end of the preceding run of time came after its parent's death.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.session import checkpointed

_MIN, _MAX = -(1 << 63), (1 << 63) - 1
#: Runs of keys are cut where their integers pass a multiple of this power of two, so that no task sorts all keys of a scope.
RUN_BITS = 16
_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: The last digits of an id, as many as fit 63 bits and without a leading zero, with the text behind them.
_DIGITS = r"^(?:.*[^0-9])?((?:[1-9][0-9]{0,17}|0)[^0-9]*)$"
_KEY_RUN, _LIVE_RUN, _REFERENCE = 0, 1, 2
_ORDER = ["_scope", "_hi", "_lo", "_t", "_rank"]


def reference_key(c: str | Column) -> Column:
    """The key without surrounding white space; null where there is no reference (null, blank, '.')."""
    t = F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(" \t\n\r\x0b\f"))
    return F.when((t != "") & (t != "."), t)


def integer_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with _scope, _hi and _lo: the integer that the last of ``keys`` stands for, in two halves, within the others."""
    *within, name = keys
    text = F.col("_text")
    uuid = (F.length("_text") == 36) & text.rlike(_UUID)
    # each text is matched once, in its own step
    df = df.withColumn("_text", F.col(name).cast("string")).withColumn("_uuid", uuid).withColumn("_tail", F.when(~F.col("_uuid"), F.regexp_extract("_text", _DIGITS, 1)).otherwise(""))
    uuid, digits = F.col("_uuid"), F.col("_tail") != ""
    number = F.regexp_extract("_tail", "^[0-9]+", 0).try_cast("long")
    df = df.withColumn("_number", F.when(digits, number)).withColumn("_hex", F.when(uuid, F.translate("_text", "-", "")))
    half = lambda at: F.conv(F.substring("_hex", at, 16), 16, -10).cast("long")
    around = F.concat(F.expr("left(_text, length(_text) - length(_tail))"), F.lit("#"), F.expr("substring(_tail, length(cast(_number as string)) + 1)"))
    scope = F.xxhash64(*[F.col(k) for k in within], F.when(digits, around), F.when(uuid, 0).when(digits, 1).otherwise(2))
    hi = F.when(uuid, half(1)).when(digits, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit("hi"), text))
    lo = F.when(uuid, half(17)).when(digits, F.col("_number")).otherwise(F.xxhash64(F.lit("lo"), text))
    return df.withColumns({"_scope": scope, "_hi": hi, "_lo": lo}).drop("_text", "_uuid", "_tail", "_number", "_hex")


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _complete(keys: list[str]) -> Column:
    ok = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        ok = ok & F.col(k).isNotNull()
    return ok


def _segment_maxima(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Largest value so far within each stretch of equal ``group`` numbers, which ascend."""
    order, rank = np.unique(value, return_inverse=True)
    return order[np.maximum.accumulate(group * len(order) + rank) - group * len(order)]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of keys and of live time, of parents in the order of _scope, _hi, _lo, _from, _until."""
    key: np.ndarray | None = None  # the run of keys and the run of time that may go on in the next batch
    life: np.ndarray | None = None

    def out(keys: np.ndarray, lives: np.ndarray) -> pa.RecordBatch:
        # a run of keys is scope, hi, first, last; one of time is scope, hi, lo, from, until
        n, m = keys.shape[1], lives.shape[1]
        both = [np.r_[keys[i], lives[i]] for i in range(3)]
        last, until = np.r_[keys[3], np.zeros(m, np.int64)], np.r_[np.zeros(n, np.int64), lives[4]]
        columns = [*both, np.r_[np.full(n, _MIN), lives[3]], np.r_[np.full(n, _KEY_RUN), np.full(m, _LIVE_RUN)].astype(np.int32), last, until]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_ORDER, "_last", "_until"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("_scope", "_hi", "_lo", "_from", "_until")])
        rows = rows if life is None else np.c_[life, rows]
        change = (np.diff(rows[:3]) != 0).any(axis=0)
        group = np.cumsum(np.r_[0, change])
        reach = _segment_maxima(group, rows[4])
        first = np.flatnonzero(np.r_[True, change | (rows[3][1:] > reach[:-1])])
        lives = np.concatenate([rows[:4, first], reach[np.r_[first[1:] - 1, rows.shape[1] - 1]][None]])
        distinct = rows[:3, np.flatnonzero(np.r_[True, change])]
        keys = np.concatenate([distinct, distinct[2:]])
        if key is not None:
            # the first key of this batch may be the last of the run that is held
            keys = np.c_[key, keys[:, int((keys[:2, :1] == key[:2]).all() and keys[2, 0] <= key[3, 0]) :]]
        starts = np.flatnonzero(np.r_[True, (np.diff(keys[:2]) != 0).any(axis=0) | (keys[2, 1:] != keys[3, :-1] + 1)])
        keys = np.concatenate([keys[:3, starts], keys[3:, np.r_[starts[1:] - 1, keys.shape[1] - 1]]])
        yield out(keys[:, :-1], lives[:, :-1])
        key, life = keys[:, -1:], lives[:, -1:]
    if key is not None:
        yield out(key, life)


def parent_runs(parents: DataFrame, keys: list[str], born: str, died: str) -> DataFrame:
    """The sorted integer keys of ``parents`` as contiguous runs, and the live time of each key as runs.

    A row of rank 0 is a run of the keys ``_lo`` to ``_last``, both inclusive; one of rank 1 a run of live time of the key
    ``_lo`` from ``_t`` until ``_until`` (half-open microseconds). A row without ``died`` lives on. A row without ``born``
    was never live; it gives an empty run at the start of time. Repeated, nested and touching rows make one run.
    """
    rows = parents.where(_complete(keys)).select(
        *keys,
        F.coalesce(_micros(born), F.lit(_MIN)).alias("_from"),
        F.when(F.col(born).isNull(), F.lit(_MIN)).otherwise(F.coalesce(_micros(died), F.lit(_MAX))).alias("_until"),
    )
    rows = integer_keys(rows, keys).select("_scope", "_hi", "_lo", "_from", "_until").withColumn("_part", F.shiftright("_lo", RUN_BITS))
    rows = rows.repartition("_scope", "_hi", "_part").sortWithinPartitions("_scope", "_hi", "_lo", "_from", "_until").drop("_part")
    return rows.mapInArrow(_runs, "_scope long, _hi long, _lo long, _t long, _rank int, _last long, _until long")


def _last_runs(ordered: DataFrame) -> list[dict[int, tuple]]:
    """For each partition the last run of each rank that starts before it; one row a partition and rank comes to the driver."""
    run = F.struct("_scope", "_hi", "_lo", "_last", "_until")
    tails = ordered.where(F.col("_rank") != _REFERENCE).groupBy(F.spark_partition_id().alias("p"), "_rank").agg(F.max_by(run, F.struct(*_ORDER)).alias("r"))
    by_part: dict[int, dict[int, tuple]] = {}
    for row in tails.collect():
        by_part.setdefault(row["p"], {})[row["_rank"]] = tuple(row["r"])
    seeds: list[dict[int, tuple]] = []
    so_far: dict[int, tuple] = {}
    for p in range(max(by_part, default=-1) + 2):
        seeds.append(dict(so_far))
        so_far |= by_part.get(p, {})
    return seeds


def _as_of(seeds: list[dict[int, tuple]], carried: list[str]):
    """Kinds of the references of one ordered partition."""
    names = ["_scope", "_hi", "_lo", "_last", "_until"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = dict(seeds[min(TaskContext.get().partitionId(), len(seeds) - 1)])
        for batch in batches:
            if not batch.num_rows:
                continue
            # the runs that reach into the batch stand in front of it
            ahead = [before.get(rank) for rank in (_KEY_RUN, _LIVE_RUN)]
            rank = np.r_[[_KEY_RUN, _LIVE_RUN], batch.column("_rank").to_numpy()]
            known = np.r_[[a is not None for a in ahead], np.ones(batch.num_rows, bool)]
            v = {n: np.r_[np.array([a[i] if a else 0 for a in ahead], np.int64), batch.column(n).to_numpy()] for i, n in enumerate(names)}
            t = np.r_[np.zeros(2, np.int64), batch.column("_t").to_numpy()]
            place = np.arange(len(rank))
            preceding = {r: np.maximum.accumulate(np.where((rank == r) & known, place, -1)) for r in (_KEY_RUN, _LIVE_RUN)}
            ref = np.flatnonzero(rank == _REFERENCE)
            keys, lives = preceding[_KEY_RUN][ref], preceding[_LIVE_RUN][ref]
            same = lambda at: (at >= 0) & (v["_scope"][at] == v["_scope"][ref]) & (v["_hi"][at] == v["_hi"][ref])
            exists = same(keys) & (v["_lo"][ref] <= v["_last"][keys])
            begun = same(lives) & (v["_lo"][lives] == v["_lo"][ref])
            live = begun & (t[ref] < v["_until"][lives])
            timed = t[ref] < _MAX
            kind = np.where(~exists, "missing", np.where(begun, "deleted", "late"))
            keep = ~exists | (timed & ~live)
            rows = pa.array(ref[keep] - 2)
            out = [batch.column(c).take(rows) for c in carried]
            yield pa.RecordBatch.from_arrays([*out, pa.array(kind[keep].tolist(), pa.string())], names=[*carried, "kind"])
            for r in (_KEY_RUN, _LIVE_RUN):
                if (at := int(preceding[r][-1])) >= 0:
                    before[r] = tuple(int(v[n][at]) for n in names)

    return run


def orphan_references(refs: DataFrame, parents: DataFrame, keys: list[str], at: str, born: str, died: str, carry: list[str] | None = None) -> DataFrame:
    """Rows of ``refs`` without a live parent at the instant ``at``, with ``kind``.

    ``refs`` and ``parents`` both carry ``keys``, of which the last is the id within the others; a row of ``refs`` with a
    null key is no reference and is left out, as is one without ``at`` whose parent exists. ``kind`` is 'missing' (no
    parent row at all), 'late' (all parent rows were born after ``at``) or 'deleted'. Rows that are repeated in ``refs``
    are reported each. Every column of ``refs`` is kept, or those named in ``carry``; columns of ``parents`` never come
    through. An empty table of parents makes every reference missing. Keys other than integers and UUIDs are compared
    by 128 bits of hash, the keys and text around an integer by 64.
    """
    carry = list(carry or refs.columns)
    inner = [f"_c{i}" for i in range(len(carry))]
    types = dict(refs.dtypes)
    code = ["_scope", "_hi", "_lo"]
    nothing = F.lit(0).cast("long")
    none = [F.lit(None).cast(types[c]).alias(n) for c, n in zip(carry, inner, strict=True)]
    known = parent_runs(parents, keys, born, died).select("*", nothing.alias("_tie"), *none)
    columns = [F.col(c).alias(n) for c, n in zip(carry, inner, strict=True)]
    asked = integer_keys(refs.where(_complete(keys)), keys).select(*code, F.coalesce(_micros(at), F.lit(_MAX)).alias("_t"), F.lit(_REFERENCE).alias("_rank"), nothing.alias("_last"), nothing.alias("_until"), *columns)
    # references that are alike but for what they carry may be many: their hash lets the exchange split them
    asked = asked.withColumn("_tie", F.xxhash64(*inner)).select(known.columns)
    ordered = known.unionByName(asked).repartitionByRange(*_ORDER, "_tie").sortWithinPartitions(*_ORDER)
    ordered = checkpointed(ordered.drop("_tie"))
    schema = ", ".join(f"{n} {types[c]}" for c, n in zip(carry, inner, strict=True)) + ", kind string"
    return ordered.mapInArrow(_as_of(_last_runs(ordered), inner), schema).toDF(*carry, "kind")
