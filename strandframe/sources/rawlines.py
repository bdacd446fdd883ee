"""Loading of raw block BED and "all" TSV lines, with the broken ones set apart.

The lines of a batch that have one layout are a block, which vectorised Arrow kernels parse at once. A
block that fails is cut in half again and again, until what passes is loaded from the parsed columns
and single lines are left. Those are read by a strict parser, which knows quoting and every rule,
and either loads the line or names the reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.session import broadcast_if_small

# Fixed values of the two formats.
MISSING = ("", ".", "NA", "NaN", "nan")
STRANDS = ("+", "-", ".")
LIST_COLUMNS = ("ref_nuc_starts", "ref_nuc_lengths", "ref_msp_starts", "ref_msp_lengths", "ref_m6a", "m6a_qual", "ref_5mC", "5mC_qual")
EQUAL_LENGTHS = (("ref_nuc_starts", "ref_nuc_lengths"), ("ref_msp_starts", "ref_msp_lengths", "fire"), ("ref_m6a", "m6a_qual"), ("ref_5mC", "5mC_qual"))
POSITION_QUALITY = (("ref_m6a", "m6a_qual"), ("ref_5mC", "5mC_qual"))
NOT_EMPTY = ("ct", "st", "en", "fiber", "strand")
TEXT_COLUMNS = ("HP", "RG", "fiber_length")

_LONGS = pa.list_(pa.int64())
_OUT = pa.schema(
    [("rec_id", pa.int64()), ("fmt", pa.string()), ("file_name", pa.string()), ("line_no", pa.int64()), ("reason", pa.string())]
    + [("chrom", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("strand", pa.string())]
    + [("score", pa.string()), ("thick_start", pa.int64()), ("thick_end", pa.int64()), ("rgb", pa.string()), ("sizes", _LONGS), ("starts", _LONGS)]
    + [("hp", pa.string()), ("rg", pa.string()), ("fiber_length", pa.string())]
    + [(c.lower().replace("5mc", "m5c"), _LONGS) for c in LIST_COLUMNS]
    + [("fire", pa.list_(pa.float64()))]
)
_DDL = (
    "rec_id long, fmt string, file_name string, line_no long, reason string, chrom string, start long, end long, name string, strand string, "
    "score string, thick_start long, thick_end long, rgb string, sizes array<long>, starts array<long>, hp string, rg string, fiber_length string, "
    + ", ".join(f"{c.lower().replace('5mc', 'm5c')} array<long>" for c in LIST_COLUMNS)
    + ", fire array<double>"
)

_INT = re.compile(r"-?[0-9]+\Z")
_NUMBER = re.compile(r"[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\Z")
_SURE_INT = r"^-?[0-9]{1,18}$"
_SURE_COUNTS = r"^[0-9]{1,18}(,[0-9]{1,18})*,?$"
_SURE_LIST = r"^(-?[0-9]{1,18}|\.|NA|NaN|nan)?(,(-?[0-9]{1,18}|\.|NA|NaN|nan)?)*$"
_SURE_NUMBERS = r"^([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]{1,2})?|\.|NA|NaN|nan)?(,([-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]{1,2})?|\.|NA|NaN|nan)?)*$"


class _Broken(Exception):
    """A line breaks a rule; the message is the reason."""


def split_fields(line: str) -> list[str]:
    """Fields of a line, parted by tabs, with quoting; raises on a quote that doesn't end its field."""
    if '"' not in line:
        return line.split("\t")
    fields, at, n = [], 0, len(line)
    while True:
        if at < n and line[at] == '"':
            value, at = [], at + 1
            while True:
                end = line.find('"', at)
                if end < 0:
                    raise _Broken("unclosed_quote")
                value.append(line[at:end])
                if line.startswith('""', end):
                    value.append('"')
                    at = end + 2
                    continue
                at = end + 1
                break
            if at < n and line[at] != "\t":
                raise _Broken("text_after_quote")
            fields.append("".join(value))
        else:
            end = line.find("\t", at)
            end = n if end < 0 else end
            fields.append(line[at:end])
            at = end
        if at >= n:
            return fields
        at += 1


def _whole(text: str, what: str) -> int:
    if not _INT.match(text):
        raise _Broken(f"not_an_integer:{what}")
    value = int(text)
    if not -(1 << 63) <= value < 1 << 63:
        raise _Broken(f"integer_out_of_range:{what}")
    return value


def _entries(cell: str) -> list[str]:
    return (cell[:-1] if cell.endswith(",") else cell).split(",")


def strict_block_bed(line: str) -> dict:
    """A block BED line as a row; raises with the reason where it breaks a rule."""
    f = split_fields(line)
    if len(f) not in (10, 11, 12):
        raise _Broken("column_count")
    start, end, thick_start, thick_end = (_whole(f[i], n) for i, n in ((1, "start"), (2, "end"), (6, "thick_start"), (7, "thick_end")))
    if start > end:
        raise _Broken("start_after_end")
    if thick_start > thick_end:
        raise _Broken("thick_start_after_end")
    if f[5] not in STRANDS:
        raise _Broken("strand")
    sizes, starts = ([_whole(x, what) for x in _entries(cell)] for cell, what in ((f[-2], "sizes"), (f[-1], "starts")))
    if len(sizes) != len(starts):
        raise _Broken("list_lengths_differ:sizes,starts")
    if min(sizes) < 0 or min(starts) < 0:
        raise _Broken("negative_entry")
    if max(starts) > end - start:
        raise _Broken("start_beyond_record")
    if len(f) == 12 and _whole(f[9], "block_count") != len(sizes):
        raise _Broken("block_count")
    return {
        "chrom": f[0], "start": start, "end": end, "name": f[3], "strand": f[5], "score": f[4], "thick_start": thick_start,
        "thick_end": thick_end, "rgb": f[8] if len(f) > 10 else None, "sizes": sizes, "starts": starts,
    }


def read_header(line: str) -> list[str] | None:
    """Column names of an "all" file; null where its first line can't be read."""
    try:
        fields = split_fields(line.removesuffix("\r"))
    except _Broken:
        return None
    return [x.removeprefix("#") for x in fields]


def strict_all(line: str, header: list[str] | None) -> dict:
    """An "all" line as a row; raises with the reason where it breaks a rule."""
    if header is None:
        raise _Broken("no_header")
    f = split_fields(line)
    if len(f) != len(header):
        raise _Broken("column_count")
    cell = dict(zip(header, f, strict=True))
    for c in NOT_EMPTY:
        if not cell.get(c):
            raise _Broken(f"empty:{c}")
    row = {"chrom": cell["ct"], "start": _whole(cell["st"], "st"), "end": _whole(cell["en"], "en"), "name": cell["fiber"], "strand": cell["strand"]}
    row |= {c.lower(): cell.get(c) for c in TEXT_COLUMNS}
    lists: dict[str, list] = {}
    for c in LIST_COLUMNS:
        if c in cell:
            lists[c] = [None if x in MISSING else _whole(x, c) for x in _entries(cell[c])]
    if "fire" in cell:
        tokens = _entries(cell["fire"])
        if any(x not in MISSING and not _NUMBER.match(x) for x in tokens):
            raise _Broken("not_a_number:fire")
        lists["fire"] = [None if x in MISSING else float(x) for x in tokens]
    for group in EQUAL_LENGTHS:
        there = [c for c in group if c in lists]
        if len({len(lists[c]) for c in there}) > 1:
            raise _Broken("list_lengths_differ:" + ",".join(there))
    for position, quality in POSITION_QUALITY:
        if position in lists and quality in lists:
            for p, q in zip(lists[position], lists[quality], strict=True):
                if p is not None and p >= 0 and (q is None or not 0 <= q <= 255):
                    raise _Broken(f"quality_range:{quality}")
    return row | {c.lower().replace("5mc", "m5c"): v for c, v in lists.items()}


def _mask(a: pa.Array) -> np.ndarray:
    return pc.fill_null(a, False).to_numpy(zero_copy_only=False)


def _matches(c: pa.Array, pattern: str) -> np.ndarray:
    return _mask(pc.match_substring_regex(c, pattern))


class _Block:
    """Columns of lines of one layout, and which of the lines are beyond doubt valid.

    A cell that a kernel can't vouch for is null (an empty list), so that the others can be parsed at once.
    """

    def __init__(self, lines: pa.Array, names: list[str]) -> None:
        n = len(names)
        flat = pc.list_flatten(pc.split_pattern(lines, "\t"))
        if len(flat) != n * len(lines):
            raise pa.ArrowInvalid("lines of another number of fields")
        self.sure = np.ones(len(lines), dtype=bool)
        self.cell = {name: flat.take(pa.array(np.arange(i, len(flat), n))) for i, name in enumerate(names)}
        self.out: dict[str, pa.Array] = {}

    def vouch(self, ok: np.ndarray) -> None:
        self.sure &= ok

    def _where(self, ok: np.ndarray, c: pa.Array) -> pa.Array:
        return pc.if_else(pa.array(ok), c, pa.scalar(None, pa.string()))

    def whole(self, name: str) -> pa.Array:
        ok = _matches(self.cell[name], _SURE_INT)
        self.vouch(ok)
        return self._where(ok, self.cell[name]).cast(pa.int64())

    def list_of(self, name: str, pattern: str, to: pa.DataType, missing: bool = True) -> pa.ListArray:
        ok = _matches(self.cell[name], pattern)
        self.vouch(ok)
        split = pc.split_pattern(pc.replace_substring_regex(self._where(ok, self.cell[name]).fill_null("0"), ",$", ""), ",")
        flat = pc.list_flatten(split)
        if missing:
            flat = pc.if_else(pc.is_in(flat, pa.array(MISSING)), pa.scalar(None, pa.string()), flat)
        return pa.ListArray.from_arrays(split.offsets, flat.cast(to))

    def same_lengths(self, lists: list[pa.ListArray]) -> None:
        first = pc.list_value_length(lists[0])
        for other in lists[1:]:
            self.vouch(_mask(pc.equal(first, pc.list_value_length(other))))

    def deny_lines_of(self, entries: np.ndarray, of: pa.ListArray) -> None:
        """Lines that hold one of the marked list entries are in doubt."""
        self.sure[pc.list_parent_indices(of).to_numpy()[entries]] = False


BED_COLUMNS = ("chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "rgb", "block_count", "sizes", "starts")


def bed_names(n: int) -> list[str]:
    """Names of the fields of a block BED line of 10, 11 or 12 fields."""
    return [*BED_COLUMNS[:8], *{10: (), 11: ("rgb",), 12: ("rgb", "block_count")}[n], "sizes", "starts"]


def bulk_block_bed(lines: pa.Array, n: int) -> _Block:
    b = _Block(lines, bed_names(n))
    start, end, thick_start, thick_end = (b.whole(c) for c in ("start", "end", "thick_start", "thick_end"))
    b.vouch(_mask(pc.less_equal(start, end)))
    b.vouch(_mask(pc.less_equal(thick_start, thick_end)))
    b.vouch(_mask(pc.is_in(b.cell["strand"], pa.array(STRANDS))))
    sizes, starts = (b.list_of(c, _SURE_COUNTS, pa.int64(), missing=False) for c in ("sizes", "starts"))
    b.same_lengths([sizes, starts])
    span = pc.subtract(end, start).take(pc.list_parent_indices(starts))
    b.deny_lines_of(~_mask(pc.less_equal(pc.list_flatten(starts), span)), starts)
    if n == 12:
        b.vouch(_mask(pc.equal(b.whole("block_count"), pc.list_value_length(sizes).cast(pa.int64()))))
    b.out = {c: b.cell[c] for c in ("chrom", "name", "strand", "score", "rgb") if c in b.cell}
    b.out |= {"start": start, "end": end, "thick_start": thick_start, "thick_end": thick_end, "sizes": sizes, "starts": starts}
    return b


def bulk_all(lines: pa.Array, header: list[str]) -> _Block:
    b = _Block(lines, header)
    for c in NOT_EMPTY:
        b.vouch(_mask(pc.not_equal(b.cell[c], "")) if c in b.cell else np.zeros(len(lines), dtype=bool))
    if not b.sure.any():
        return b
    b.out = {"chrom": b.cell["ct"], "start": b.whole("st"), "end": b.whole("en"), "name": b.cell["fiber"], "strand": b.cell["strand"]}
    b.out |= {c.lower(): b.cell[c] for c in TEXT_COLUMNS if c in b.cell}
    lists = {c: b.list_of(c, _SURE_LIST, pa.int64()) for c in LIST_COLUMNS if c in b.cell}
    if "fire" in b.cell:
        lists["fire"] = b.list_of("fire", _SURE_NUMBERS, pa.float64())
    for group in EQUAL_LENGTHS:
        if there := [lists[c] for c in group if c in lists]:
            b.same_lengths(there)
    for position, quality in POSITION_QUALITY:
        if position in lists and quality in lists:
            # lists of other lengths are left out here, so that the entries of both stand side by side
            of = np.flatnonzero(_mask(pc.equal(pc.list_value_length(lists[position]), pc.list_value_length(lists[quality]))))
            at, values = lists[position].take(pa.array(of)), lists[quality].take(pa.array(of))
            p, q = pc.list_flatten(at), pc.list_flatten(values)
            right = _mask(pc.and_(pc.greater_equal(q, 0), pc.less_equal(q, 255)))
            wrong = _mask(pc.greater_equal(p, 0)) & ~right
            b.sure[of[pc.list_parent_indices(at).to_numpy()[wrong]]] = False
    b.out |= {c.lower().replace("5mc", "m5c"): v for c, v in lists.items()}
    return b


def clean_stretches(sure: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Stretches of a block that passed whole, and the single lines in doubt, found by halving what failed.

    The verdicts on a block's lines are summed once, so whether a half passes is a subtraction and not a second parse.
    """
    failed = np.r_[0, np.cumsum(~sure)]
    passed: list[tuple[int, int]] = []
    alone: list[int] = []
    stack = [(0, len(sure))] if len(sure) else []
    while stack:
        low, high = stack.pop()
        n = failed[high] - failed[low]
        if n == 0:
            if passed and passed[-1][1] == low:
                passed[-1] = (passed[-1][0], high)
            else:
                passed.append((low, high))
        elif high - low == 1:
            alone.append(low)
        else:
            middle = (low + high) // 2
            stack += [(middle, high), (low, middle)]
    return passed, alone


def _unquoted(raw: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lines whose quoted fields hold no tab and no quote, without those quotes; and which lines have other quotes."""
    quoted = _matches(raw, r'(^|\t)"')
    if not quoted.any():
        return raw, quoted
    plain = _matches(raw, r'^("[^"\t]*"|[^"\t][^\t]*|)(\t("[^"\t]*"|[^"\t][^\t]*|))*$')
    freed = pc.replace_substring_regex(raw, r'(^|\t)"([^"\t]*)"', r"\1\2")
    return pc.if_else(pa.array(quoted & plain), freed, raw), quoted & ~plain


def _columns(cols: dict[str, pa.Array], n: int) -> pa.Table:
    return pa.table([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def _layouts(batch: pa.RecordBatch, lines: pa.Array, quoted: np.ndarray) -> Iterator[tuple[str | None, str, int, bool, np.ndarray]]:
    """Format, header text, number of fields, odd quotes and row numbers of each layout among the records of a batch."""
    record = _mask(pc.not_equal(pc.utf8_trim_whitespace(lines), "")) & ~_mask(pc.starts_with(lines, "#"))
    kind, head = batch.column("fmt").dictionary_encode(), batch.column("header").fill_null("").dictionary_encode()
    kinds = kind.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    heads = head.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_fields = pc.count_substring(lines, "\t").to_numpy(zero_copy_only=False).astype(np.int64) + 1
    rows = np.flatnonzero(record)
    keys = np.stack([kinds, heads, np.where(quoted, 0, n_fields), quoted.astype(np.int64)])[:, rows]
    order = np.lexsort(keys)
    cuts = np.flatnonzero(np.r_[True, (np.diff(keys[:, order]) != 0).any(axis=0)]) if len(rows) else []
    for part in np.split(order, cuts[1:]) if len(rows) else []:
        k, h, n, odd = keys[:, part[0]].tolist()
        yield None if k < 0 else kind.dictionary[k].as_py(), head.dictionary[h].as_py(), n, bool(odd), np.sort(rows[part])


def _bulk(lines: pa.Array, kind: str | None, n_fields: int, header: list[str] | None) -> _Block | None:
    """The block as the columnar path reads it; null where no layout fits."""
    try:
        if kind == "block_bed" and n_fields in (10, 11, 12):
            return bulk_block_bed(lines, n_fields)
        if kind == "all_tsv" and header is not None and n_fields == len(header) and len(set(header)) == n_fields:
            return bulk_all(lines, header)
    except pa.ArrowInvalid:
        pass
    return None


def _diagnosed(line: str, kind: str | None, header: list[str] | None) -> dict:
    try:
        if kind not in ("block_bed", "all_tsv"):
            raise _Broken("unknown_format")
        return {"reason": None} | (strict_block_bed(line) if kind == "block_bed" else strict_all(line, header))
    except _Broken as why:
        return {"reason": str(why)}


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    headers: dict[str, list[str] | None] = {}
    for batch in batches:
        ids = {c: batch.column(c) for c in ("rec_id", "fmt", "file_name", "line_no")}
        raw = pc.replace_substring_regex(batch.column("line").fill_null(""), "\r$", "")
        lines, odd_quotes = _unquoted(raw)
        done: list[pa.Table] = []
        doubtful: list[np.ndarray] = []
        strict: list[dict] = []
        for kind, head, n_fields, odd, at in _layouts(batch, lines, odd_quotes):
            if head and head not in headers:
                headers[head] = read_header(head)
            header = headers.get(head) if head else None
            block = None if odd else _bulk(lines.take(pa.array(at)), kind, n_fields, header)
            passed, alone = clean_stretches(block.sure if block else np.zeros(len(at), dtype=bool))
            for low, high in passed:
                rows = pa.array(at[low:high])
                cols = {c: v.slice(low, high - low) for c, v in block.out.items()} | {c: v.take(rows) for c, v in ids.items()}
                done.append(_columns(cols, high - low))
            if alone:
                doubtful.append(at[alone])
                strict += [_diagnosed(line, kind, header) for line in raw.take(pa.array(at[alone])).to_pylist()]
        if strict:
            cells = pa.Table.from_pylist(strict, schema=_OUT)
            rows = pa.array(np.concatenate(doubtful))
            for c, v in ids.items():
                cells = cells.set_column(_OUT.get_field_index(c), _OUT.field(c), v.take(rows).cast(_OUT.field(c).type))
            done.append(cells)
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()


def load_raw_lines(lines: DataFrame) -> DataFrame:
    """Every record of ``lines`` (rec_id, fmt, file_name, line_no, line), loaded or with its ``reason``.

    ``reason`` is null for a valid record, whose fields are loaded; else it names the broken rule, and the
    fields are null. Blank and null lines, lines that start with '#' and the first line of an "all" file are
    no records and give no row. An integer that doesn't fit 64 bits can't be loaded and is a reason. An "all"
    file without a readable first line has 'no_header' as reason of each record. Lines of another ``fmt``
    have 'unknown_format'. Lines of any length are read whole; repeated lines are each a record; other
    columns of ``lines`` are ignored.
    """
    src = lines.select(F.col("rec_id").cast("long"), "fmt", "file_name", F.col("line_no").cast("long"), "line")
    heads = src.where("fmt = 'all_tsv' and line_no = 1 and file_name is not null").groupBy(F.col("file_name").alias("of_file")).agg(F.min("line").alias("header"))
    heads = broadcast_if_small(heads, ["of_file", "header"])
    of = F.when(F.col("fmt") == "all_tsv", F.col("file_name"))
    body = src.where("not (fmt <=> 'all_tsv' and line_no <=> 1)")
    joined = body.join(heads, of == F.col("of_file"), "left").drop("of_file")
    return joined.select("rec_id", "fmt", "file_name", "line_no", "line", "header").mapInArrow(_load, _DDL)
