"""Percentiles per group from dyadic Count-sketches.

A value is encoded as a 32-bit code that keeps its order. Each level halves the code's resolution; a
level with more nodes than ``WIDTH`` is held in a Count-sketch of ``DEPTH`` signed rows, a coarser one in
exact counters. All counters are sums, so sketches of partitions or days are merged by addition, and a
row is deleted by a weight of -1. A rank is inverted by descending the levels of the counters, whatever the
group's size. Only what is stored and sent differs: the state of a group with few distinct codes is the list
of (code, weight) of which its counters are the linear image, and is turned into them when ranks are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS, DEPTH, WIDTH_BITS = 32, 7, 11
WIDTH = 1 << WIDTH_BITS
#: Levels 0 .. SKETCHED-1 have more than WIDTH nodes.
SKETCHED = BITS - WIDTH_BITS
#: Rank error as a share of the group's rows that these sizes keep with probability over 0.99.
RANK_ERROR = 0.01
#: Distinct codes up to which a state is sent as their list, which is smaller than the counters. It changes no answer.
SPARSE_CODES = 4096
#: Codes that wait until they are taken into the counters together.
ADD_AT_ONCE = 1 << 15
_DENSE_AT_ONCE, _WAITING_AT_ONCE = 24, 1 << 22
_STATE = "level int, row int, codes binary, weights binary"

_rng = np.random.Generator(np.random.PCG64(0x5EED))
_A = _rng.integers(1 << 62, (1 << 63) - 1, (SKETCHED, DEPTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, (1 << 63) - 1, (SKETCHED, DEPTH), dtype=np.uint64)


def encode(values: np.ndarray) -> np.ndarray:
    """Order-keeping codes: sign, exponent and the first 20 bits of the fraction (an error of 1e-6 of the value)."""
    bits = (np.asarray(values, np.float64) + 0.0).view(np.int64)
    ordered = np.where(bits < 0, ~bits, bits | np.int64(-(1 << 63))).view(np.uint64)
    return (ordered >> np.uint64(32)).astype(np.int64)


def decode(code: int) -> float:
    """The least absolute value with the code."""
    ordered = np.uint64(code) << np.uint64(32)
    if code >> 31:
        return float((np.array([ordered], np.uint64) & np.uint64((1 << 63) - 1)).view(np.float64)[0])
    return float((~np.array([ordered | np.uint64(0xFFFFFFFF)], np.uint64)).view(np.float64)[0])


def _places(level: int, row: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = nodes.astype(np.uint64) * _A[level, row] + _B[level, row]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return (h & np.uint64(WIDTH - 1)).astype(np.int64), 1 - 2 * ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


class Sketch:
    """State of one group: sparse codes with weights, or dense counters."""

    def __init__(self) -> None:
        self.codes, self.weights = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.cells: np.ndarray | None = None  # sketched levels x rows x width
        self.tops: np.ndarray | None = None  # exact counters of the finest exact level
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n_waiting = 0

    def add(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self._waiting.append((codes, weights))
        self._n_waiting += len(codes)
        if self._n_waiting >= ADD_AT_ONCE:
            self.settle()

    def settle(self) -> None:
        """Take in the codes that wait; they are gathered since a pass over all counters costs the same for one as for many."""
        if not self._n_waiting:
            return
        codes = np.concatenate([c for c, _ in self._waiting] + [self.codes])
        weights = np.concatenate([w for _, w in self._waiting] + [self.weights])
        self._waiting, self._n_waiting = [], 0
        codes, at = np.unique(codes, return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, at, weights)
        codes, total = codes[total != 0], total[total != 0]
        if self.cells is None and len(codes) <= SPARSE_CODES:
            self.codes, self.weights = codes, total
            return
        self._densify()
        self._spread(codes, total)

    def _densify(self) -> None:
        if self.cells is None:
            self.cells = np.zeros((SKETCHED, DEPTH, WIDTH), np.int64)
            self.tops = np.zeros(WIDTH, np.int64)
            self.codes, self.weights = self.codes[:0], self.weights[:0]

    def _spread(self, codes: np.ndarray, weights: np.ndarray) -> None:
        for level in range(SKETCHED):
            nodes = codes >> level
            for row in range(DEPTH):
                place, sign = _places(level, row, nodes)
                self.cells[level, row] += np.bincount(place, sign * weights, WIDTH).astype(np.int64)
        self.tops += np.bincount(codes >> SKETCHED, weights, WIDTH).astype(np.int64)

    def add_row(self, level: int, row: int, weights: np.ndarray) -> None:
        if self.cells is None:
            # sparse codes so far are spread into the counters
            self._waiting.append((self.codes, self.weights))
            self._n_waiting += len(self.codes)
            self._densify()
        if level == SKETCHED:
            self.tops += weights
        else:
            self.cells[level, row] += weights

    def rows(self) -> Iterator[tuple[int, int, bytes | None, bytes]]:
        """The state as rows (level, row, codes, weights); level -1 is the sparse form."""
        self.settle()
        if self.cells is None:
            if len(self.codes):
                yield -1, 0, self.codes.tobytes(), self.weights.tobytes()
            return
        yield SKETCHED, 0, None, self.tops.tobytes()
        for level in range(SKETCHED):
            for row in range(DEPTH):
                yield level, row, None, self.cells[level, row].tobytes()

    def quantiles(self, shares: list[float]) -> tuple[int, list[float | None]]:
        """Rows in the group, and for each share the least value with at least that share of rows up to it, by the counters."""
        self.settle()
        if self.cells is None:
            codes, weights = self.codes, self.weights
            self._densify()
            self._spread(codes, weights)
        n = int(self.tops.sum())
        if n <= 0:
            return 0, [None] * len(shares)
        upto = np.cumsum(self.tops)
        rank = np.array([_rank(q, n) for q in shares], np.float64)
        node = np.searchsorted(upto, rank, "right")
        rank -= np.where(node > 0, upto[node - 1], 0)
        inside = self.tops[node].astype(np.float64)
        for level in range(SKETCHED - 1, -1, -1):
            children = np.stack([2 * node, 2 * node + 1])
            votes = []
            for row in range(DEPTH):
                place, sign = _places(level, row, children)
                votes.append(sign * self.cells[level, row][place])
            left, right = np.maximum(0.0, np.median(votes, axis=0))
            # the two children share what their parent holds
            with np.errstate(invalid="ignore", divide="ignore"):
                left = np.where(left + right > 0, left * inside / (left + right), inside / 2)
            goes_left = rank < left
            node = np.where(goes_left, children[0], children[1])
            rank = np.where(goes_left, rank, rank - left)
            inside = np.where(goes_left, left, inside - left)
        return n, [decode(int(x)) for x in node]


def _rank(share: float, n: int) -> int:
    return min(n - 1, max(0, int(np.ceil(share * n - 1e-9)) - 1))


def _emit(keys: list[pa.Array], at: list[tuple[int, Sketch]], names: list[str]) -> Iterator[pa.RecordBatch]:
    picked, rows = [], []
    for i, sketch in at:
        for r in sketch.rows():
            picked.append(i)
            rows.append(r)
        if len(rows) >= 1000:
            yield _state_batch(keys, picked, rows, names)
            picked, rows = [], []
    if rows:
        yield _state_batch(keys, picked, rows, names)


def _state_batch(keys: list[pa.Array], picked: list[int], rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = [k.take(pa.array(picked, pa.int64())) for k in keys]
    cols += [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(cols, names=[*names, "level", "row", "codes", "weights"])


def _build(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # states of all groups of the task; dense ones are sent on when there are many
        groups: dict[tuple, Sketch] = {}
        types: list[pa.DataType] = []
        dense = waiting = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys = [pa.array([g[i] for g in groups], t) for i, t in enumerate(types)]
            yield from _emit(keys, list(enumerate(groups.values())), names)
            groups.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(n).type for n in names]
            index = [batch.column(n).dictionary_encode() for n in names]
            codes = [k.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for k in index]
            order = np.lexsort(codes)
            change = np.zeros(len(order), bool)
            change[0] = True
            for c in codes:
                change[1:] |= np.diff(c[order]) != 0
            heads = np.flatnonzero(change)
            value = encode(batch.column("value").to_numpy(zero_copy_only=False))
            weight = batch.column("weight").to_numpy(zero_copy_only=False)
            for a, b in zip(heads, np.r_[heads[1:], len(order)], strict=True):
                key = tuple(batch.column(n)[int(order[a])].as_py() for n in names)
                sketch = groups.get(key)
                if sketch is None:
                    sketch = groups[key] = Sketch()
                was = sketch.cells is not None
                sketch.add(value[order[a:b]], weight[order[a:b]])
                dense += (sketch.cells is not None) - was
                waiting += int(b - a)
                if dense >= _DENSE_AT_ONCE or len(groups) > 100_000:
                    yield from out()
                    dense = waiting = 0
            if waiting > _WAITING_AT_ONCE:
                for sketch in groups.values():
                    was = sketch.cells is not None
                    sketch.settle()
                    dense += (sketch.cells is not None) - was
                waiting = 0
        if groups:
            yield from out()

    return run


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[pa.RecordBatch, int, Sketch]]:
    """One merged sketch per run of equal keys, with a batch and row that hold the keys."""
    held: tuple[pa.RecordBatch, int, Sketch] | None = None
    last: tuple | None = None
    for batch in batches:
        cols = [batch.column(n).to_pylist() for n in names]
        level, row = batch.column("level").to_pylist(), batch.column("row").to_pylist()
        for i in range(batch.num_rows):
            key = tuple(c[i] for c in cols)
            if held is None or key != last:
                if held is not None:
                    yield held
                held, last = (batch.slice(i, 1), 0, Sketch()), key
            weights = np.frombuffer(batch.column("weights")[i].as_py(), np.int64)
            if level[i] < 0:
                held[2].add(np.frombuffer(batch.column("codes")[i].as_py(), np.int64), weights)
            else:
                held[2].add_row(level[i], row[i], weights)
    if held is not None:
        yield held


def _merge(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, sketch in _groups(batches, names):
            yield from _emit([keys.column(n) for n in names], [(0, sketch)], names)

    return run


def _invert(names: list[str], shares: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, _, sketch in _groups(batches, names):
            n, values = sketch.quantiles(shares)
            if n:
                cols = [keys.column(k).take(pa.array([0] * len(shares))) for k in names]
                cols += [pa.array(shares, pa.float64()), pa.array(values, pa.float64()), pa.array([n] * len(shares), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "share", "value", "n"])

    return run


def _typed(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def build_sketches(rows: DataFrame, keys: list[str], value: str | Column, weight: str | Column | None = None) -> DataFrame:
    """Sketch rows of each group of ``keys``: one state per task and group, to be merged by ``merge_sketches``.

    Null and NaN values, and rows with a null weight, are left out; infinities are values. ``weight`` is 1 unless given; -1
    deletes an earlier row. A null key is a group of its own. Ties and zeros are counted in full. -0.0 counts as 0.0.
    Keys must not be named value, weight, level, row, codes or weights; other columns are ignored.
    """
    if set(keys) & {"value", "weight", "level", "row", "codes", "weights", "_salt"}:
        raise ValueError("a key has the name of a state column")
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    w = F.lit(1) if weight is None else F.col(weight) if isinstance(weight, str) else weight
    src = rows.select(*keys, v.alias("value"), w.cast("long").alias("weight")).where("value is not null and not isnan(value) and weight is not null")
    return src.mapInArrow(_build(keys), f"{_typed(src, keys)}, {_STATE}")


def merge_sketches(states: DataFrame, keys: list[str], fan_in: int = 16) -> DataFrame:
    """Add up the sketches of each group of ``keys`` (a subset of the keys they were built by), in a tree of two levels.

    The first level splits a group that many tasks hold over ``fan_in`` parts, so that no task meets all its states;
    a task streams its states and holds one sum at a time.
    """
    schema = f"{_typed(states, keys)}, {_STATE}"
    salted = states.select(*keys, "level", "row", "codes", "weights", F.pmod(F.spark_partition_id(), F.lit(fan_in)).alias("_salt"))
    part = salted.repartition(*keys, "_salt").sortWithinPartitions(*keys, "_salt").drop("_salt").mapInArrow(_merge(keys), schema)
    return part.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge(keys), schema)


def quantiles(states: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """keys, ``share``, ``value`` and ``n`` for merged sketches: the least value with at least that share of rows up to it.

    The rank of ``value`` is off by at most ``RANK_ERROR * n`` (and its last bits by 1e-6 of it), for groups of any
    size. A group without rows has none here.
    """
    if any(not 0 <= q <= 1 for q in shares):
        raise ValueError("shares lie in 0..1")
    schema = f"{_typed(states, keys)}, share double, value double, n long"
    return states.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_invert(keys, [float(q) for q in shares]), schema)
