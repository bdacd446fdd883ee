"""Texts that a near-copy goes on behind.

A text that was cut is near to the beginning of its copies, however deep the cut. So MinHash signatures are of
heads, in size classes: a text has the heads of 4, 16, 64, ... shingles that it is long enough for, is looked for by the
largest and found by each. Texts that share a band of a head are in one bucket, named by its least member. What
is paired is not each two members: a text's last words are its anchor, and it meets one long member of its bucket
in which the anchor stands at about the same place with something behind it. The pair is aligned at the anchor,
verified by the similarity of the text and of the part of the other that it is aligned with, and judged by how
the other goes on. A text that its first partner doesn't match meets all the others with the same anchor.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.leakage import WordCodes, shingle_hashes, window_minima
from strandframe.llm.markup import WORD
from strandframe.session import broadcast_if_small, checkpointed

SIMILARITY, SHINGLE = 0.8, 5
#: At a similarity of 0.8 the bands of a head meet with a probability of 0.985.
BANDS, BAND_ROWS = 8, 4
#: Shingles of the least head, and the factor between heads.
HEAD, HEAD_FACTOR = 4, 4
#: Shingles of the window whose least one is the anchor.
ANCHOR_WINDOW = 8
_WORDS_HASHED = 1 << 15
NOT_ALIKE, COMPLETE, CUT = 0, 1, 2

_SIGN = re.compile(r"\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|…|(?<!\.)\.{3}|[\[(](?:truncated|cut|more|gekürzt|suite|sigue)[\])])\Z", re.I)
#: The longest sign of omission with the space before it.
_SIGN_LENGTH = 40
_CLOSED = re.compile(r"[.!?…][\"'»”)\]]*(?:</[a-z]+>)?\Z")

_rng = np.random.Generator(np.random.PCG64(0xC0FFEE))
_MULT = _rng.integers(1, (1 << 63) - 1, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def plain_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def sign_at(body: str) -> int:
    """Where a sign of omission at the end begins; the length of the text where there is none."""
    low = max(0, len(body) - _SIGN_LENGTH)
    m = _SIGN.search(body, low)
    return m.start() if m else len(body)


def head_sizes(n_shingles: int) -> list[int]:
    """Sizes of the heads that a text of so many shingles has; the last is its own class."""
    out, size = [], HEAD
    while size <= n_shingles:
        out.append(size)
        size *= HEAD_FACTOR
    return out


def head_keys(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Keys of the bands of each text's heads: one row a head, the largest last. Texts have a head at least."""
    sizes = [head_sizes(len(h)) for h in hashes]
    most = max(map(len, sizes))
    flat = np.concatenate([h[: s[-1]] for h, s in zip(hashes, sizes, strict=True)])
    begins = np.cumsum([0] + [s[-1] for s in sizes[:-1]])
    # what a head has more than the one before it is a stretch; the minimum of a head is that of its stretches
    starts = np.concatenate([np.array([0, *s[:-1]], np.int64) + b for s, b in zip(sizes, begins, strict=True)])
    text = np.repeat(np.arange(len(sizes)), list(map(len, sizes)))
    place = np.concatenate([np.arange(len(s)) for s in sizes])
    low = np.full((len(sizes), most, BANDS * BAND_ROWS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for k, m in enumerate(_MULT):
            h = flat * m
            h ^= h >> np.uint64(31)
            low[text, place, k] = np.minimum.reduceat(h, starts)
        low = np.minimum.accumulate(low, axis=1).reshape(len(sizes), most, BANDS, BAND_ROWS)
        key = np.arange(BANDS, dtype=np.uint64)[None, None, :] + np.uint64(BANDS) * np.arange(most, dtype=np.uint64)[None, :, None]
        key = np.broadcast_to(key, low.shape[:3]).copy()
        for r in range(BAND_ROWS):
            key = (key ^ low[..., r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
    return [key[i, : len(s)].view(np.int64) for i, s in enumerate(sizes)]


def _hashed(batch: pa.RecordBatch, codes: WordCodes) -> Iterator[tuple[list[int], list[str], list[np.ndarray], list[np.ndarray]]]:
    """Ids, texts, shingle hashes and word codes of some texts at a time, whose words are hashed in one go."""
    ids: list[int] = []
    texts: list[str] = []
    of_words: list[np.ndarray] = []
    n = 0

    def out() -> tuple[list[int], list[str], list[np.ndarray], list[np.ndarray]]:
        # shingles over an edge belong to no text
        flat = shingle_hashes(np.concatenate(of_words), SHINGLE)
        begin, hashes = 0, []
        for w in of_words:
            hashes.append(flat[begin : max(begin, begin + len(w) - SHINGLE + 1)])
            begin += len(w)
        return ids, texts, hashes, of_words

    for of, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        ids.append(of)
        texts.append(text.as_py())
        of_words.append(codes(plain_words(texts[-1])))
        n += len(of_words[-1])
        if n >= _WORDS_HASHED:
            yield out()
            ids, texts, of_words, n = [], [], [], 0
    if ids:
        yield out()


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = WordCodes()

    def signed(ids: list[int], hashes: list[np.ndarray], may: list[bool]) -> pa.RecordBatch:
        keys = head_keys(hashes)
        own = [k[-1] if asks else k[-1][:0] for k, asks in zip(keys, may, strict=True)]
        lists = lambda of: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([x.size for x in of])].astype(np.int32)), pa.array(np.concatenate([x.ravel() for x in of])))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(keys), lists(own)], names=["id", "keys", "own"])

    for batch in batches:
        for ids, texts, hashes, _ in _hashed(batch, codes):
            at = [i for i, h in enumerate(hashes) if len(h) >= HEAD]
            if at:
                yield signed([ids[i] for i in at], [hashes[i] for i in at], [may_go_on(texts[i]) for i in at])


def buckets(texts: DataFrame) -> DataFrame:
    """``id``, the ``hubs`` of the buckets that a text is in, and ``own_hubs`` of those in which it is looked for.

    A hub is the least id of a bucket. Buckets of one text, and those in which none is looked for, are left out.
    """
    signatures = checkpointed(texts.mapInArrow(_signatures, "id long, keys array<long>, own array<long>").dropDuplicates(["id"]))
    bands = signatures.select("id", F.explode(F.transform("keys", lambda k: F.struct(k.alias("key"), F.array_contains("own", k).alias("own")))).alias("b")).select("id", "b.key", "b.own")
    hubs = bands.groupBy("key").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n"), F.max("own").alias("asked")).where("n > 1 and asked").select("key", "hub")
    held = bands.join(broadcast_if_small(hubs, []), "key")
    return held.groupBy("id").agg(F.collect_set("hub").alias("hubs"), F.collect_set(F.when(F.col("own"), F.col("hub"))).alias("own_hubs"))


def tails(short: str) -> Iterator[tuple[str, bool]]:
    """The ends of a text that are aligned, as they are, then without a sign of omission, the wider first; and whether a sign is left off."""
    body = short.rstrip()
    sign = sign_at(body)
    for own, off in ((body, False), (body[:sign].rstrip(), True)) if sign < len(body) else ((body, False),):
        for width in (80, 40):
            tail = own[-width:]
            if len(tail) >= 20:
                yield tail, off


def may_go_on(short: str) -> bool:
    """Whether any longer text could go on inside the end of this one."""
    return any(off or tail[-1].isalnum() or _CLOSED.search(tail) is None for tail, off in tails(short))


def _nearest(long: str, tail: str, at: int) -> int:
    """Where the tail stands in the longer text, as near to ``at`` as can be; -1 where it doesn't."""
    before, behind = long.rfind(tail, 0, at + len(tail)), long.find(tail, at)
    if before < 0 or behind < 0:
        return max(before, behind)
    return before if at - before <= behind - at else behind


_codes = WordCodes()


def similarity(a: str, b: str) -> float:
    """Jaccard similarity of the texts' sets of shingles."""
    x, y = (np.unique(shingle_hashes(_codes(plain_words(t)), SHINGLE)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def verdict(short: str, long: str, open_markup: bool = False) -> int:
    """How the longer text goes on behind the end of the shorter.

    CUT: in the same word, in the same line where the shorter closes no sentence, behind a sign of omission that the longer
    hasn't, or behind markup left open. COMPLETE: behind what the shorter one had finished. NOT_ALIKE: the shorter one's last
    words aren't in the longer, end it as well, or are where the texts before them are less than 0.8-similar.
    """
    for tail, off in tails(short):
        at = _nearest(long, tail, len(short.rstrip()) - len(tail))
        if at < 0:
            continue
        end = at + len(tail)
        rest = long[end:]
        if not rest.strip() or similarity(short, long[:end]) < SIMILARITY:
            return NOT_ALIKE
        inside_word = tail[-1].isalnum() and rest[0].isalnum()
        same_line = rest[0] != "\n" and bool(rest.split("\n", 1)[0].strip())
        return CUT if inside_word or off or open_markup or (same_line and _CLOSED.search(tail) is None) else COMPLETE
    return NOT_ALIKE


def _place(words_before: np.ndarray) -> np.ndarray:
    """Size class of what stands before an anchor; texts 0.8-similar up to it differ by one class at most."""
    return np.floor(np.log(words_before + 1.0) / np.log(1 / SIMILARITY)).astype(np.int64)


def anchors_of(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Places in each text of the shingles that are the least of a window; windows at either end may be shorter."""
    most = np.iinfo(np.uint64).max
    gap = np.full(ANCHOR_WINDOW - 1, most, np.uint64)
    flat = np.concatenate([gap, *(x for h in hashes for x in (h, gap))])
    low = window_minima(flat, ANCHOR_WINDOW)
    least = np.zeros(len(flat), bool)
    for k in range(ANCHOR_WINDOW):
        least[k : k + len(low)] |= low == flat[k : k + len(low)]
    out, begin = [], len(gap)
    for h in hashes:
        out.append(np.flatnonzero(least[begin : begin + len(h)]))
        begin += len(h) + len(gap)
    return out


def tail_anchor(text: str, hashes: np.ndarray, n_words: int) -> tuple[int, int, int] | None:
    """The anchor of a text's end, how many words stand before it, and how many behind it without a sign of omission."""
    if not may_go_on(text):
        return None
    body = text.rstrip()
    sign = sign_at(body)
    n = n_words - (len(plain_words(body[sign:])) if sign < len(body) else 0)
    # the last word may be cut, so the anchor stands before it
    last = hashes[max(0, n - SHINGLE - ANCHOR_WINDOW) : max(0, n - SHINGLE)]
    if not len(last):
        return None
    i = max(0, n - SHINGLE - ANCHOR_WINDOW) + int(np.argmin(last))
    return int(hashes[i : i + 1].view(np.int64)[0]), i, n - i - SHINGLE


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = WordCodes()

    def lists(of: list[np.ndarray]) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in of])].astype(np.int32)), pa.array(np.concatenate(of)))

    for batch in batches:
        for ids, texts, hashes, of_words in _hashed(batch, codes):
            at = [i for i, h in enumerate(hashes) if len(h)]
            if not at:
                continue
            ids, texts, hashes, of_words = ([x[i] for i in at] for x in (ids, texts, hashes, of_words))
            places = anchors_of(hashes)
            tails_ = [tail_anchor(t, h, len(w)) for t, h, w in zip(texts, hashes, of_words, strict=True)]
            column = lambda k: pa.array([t and t[k] for t in tails_], pa.int64())  # noqa: E731, B023
            before = np.array([t[1] if t else 0 for t in tails_])
            columns = [
                pa.array(ids, pa.int64()),
                lists([h[p].view(np.int64) for h, p in zip(hashes, places, strict=True)]),
                lists([_place(p) for p in places]),
                lists([len(w) - p - SHINGLE for w, p in zip(of_words, places, strict=True)]),
                column(0),
                pa.array(_place(before)),
                column(2),
                pa.array([int(w[-1:].view(np.int64)[0]) for w in of_words], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "anchors", "places", "behind", "tail", "tail_place", "tail_behind", "last"])


_ANCHORED = "id long, anchors array<long>, places array<long>, behind array<long>, tail long, tail_place long, tail_behind long, last long"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from strandframe.llm.truncation import open_markup

    for batch in batches:
        got = []
        for short, long in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            body = short.rstrip()
            got.append(verdict(short, long, open_markup(body[: sign_at(body)].rstrip())))
        keep = pa.array([g != NOT_ALIKE for g in got], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array(got, pa.int32()).filter(keep)], names=["id", "verdict"])


def _verdicts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The strongest verdict on each text of ``pairs`` (id, longer_id)."""

    def of(column: str, name: str) -> DataFrame:
        ids = broadcast_if_small(pairs.select(F.col(column).alias("id")).distinct(), [])
        return texts.join(ids, "id", "left_semi").select(F.col("id").alias(column), F.col("text").alias(name)).dropDuplicates([column])

    both = pairs.join(of("id", "short"), "id").join(of("longer_id", "long"), "longer_id").select("id", "short", "long")
    return both.mapInArrow(_judged, "id long, verdict int").groupBy("id").agg(F.max("verdict").alias("verdict"))


def matched_texts(texts: DataFrame) -> DataFrame:
    """``id`` and ``verdict`` (CUT or COMPLETE) of the texts that a verified near-copy goes on behind.

    ``texts`` has id, which equal texts share, and text. Texts of under 8 words have no signature and no match.
    """
    member = checkpointed(buckets(texts))
    known = broadcast_if_small(member.select("id"), [])
    anchored = texts.join(known, "id", "left_semi").mapInArrow(_anchors, _ANCHORED).dropDuplicates(["id"])
    anchored = checkpointed(anchored.join(member, "id"))
    key = lambda hub, anchor, place: F.xxhash64(hub, anchor, place)
    asked = anchored.where("tail is not null").select("id", "tail", "tail_behind", "last", F.explode("own_hubs").alias("hub"), "tail_place")
    asked = asked.select("id", "tail_behind", "last", F.explode(F.array(*[key(F.col("hub"), F.col("tail"), F.col("tail_place") + d) for d in (-1, 0, 1)])).alias("key"))
    asked = checkpointed(asked.distinct())
    places = anchored.select("id", "hubs", F.col("last").alias("longer_last"), F.explode(F.arrays_zip("anchors", "places", "behind")).alias("a"))
    places = places.select(F.col("id").alias("longer_id"), "longer_last", F.col("a.behind").alias("longer_behind"), F.explode(F.transform("hubs", lambda h: key(h, F.col("a.anchors"), F.col("a.places")))).alias("key"))
    holders = checkpointed(places.join(broadcast_if_small(asked.select("key").distinct(), []), "key", "left_semi"))
    goes_on = (F.col("id") != F.col("longer_id")) & ((F.col("longer_behind") > F.col("tail_behind")) | (F.col("longer_behind") == F.col("tail_behind")) & (F.col("last") != F.col("longer_last")))
    first = holders.groupBy("key").agg(F.max(F.struct("longer_behind", "longer_id", "longer_last")).alias("f")).select("key", "f.*")
    pairs = checkpointed(asked.join(first, "key").where(goes_on).select("id", "longer_id").distinct())
    by_first = checkpointed(_verdicts(pairs, texts))
    # what the first partner doesn't match meets every other with its anchor
    rest = asked.join(broadcast_if_small(by_first.select("id"), []), "id", "left_anti").join(holders, "key").where(goes_on).select("id", "longer_id").distinct()
    rest = checkpointed(rest.join(broadcast_if_small(pairs, []), ["id", "longer_id"], "left_anti"))
    return by_first.unionByName(_verdicts(rest, texts))
