"""Evaluation items that occur, whole or in part, inside documents.

A document as a whole is far larger than an item, so the MinHash of one says nothing of the other: what
a passage of 12 words adds to the similarity falls with the document's size, and the bands that it takes
to see it rise with it. So documents are partitioned by size until all that is compared is of one size.
A text is cut into parts of bounded length, and a part into windows as large as the shortest passage
that counts: 12 words, which are eight 5-word shingles. Each window gives one band, of which neighbours
mostly share their minimum; a part's signature has as many bands as its size calls for. Equal passages
have equal windows, and equal windows equal bands, so the search loses nothing. Bands of documents and
items meet in a join; each candidate is verified by exact containment of a window's shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.markup import words
from strandframe.session import broadcast_if_small, checkpointed

MIN_WORDS, SHINGLE = 12, 5
#: Words of a part of a document. Parts overlap by a window less a word, so that no window is lost.
PART_WORDS = 1 << 14
#: Bands sent to the join at once.
_BANDS_AT_ONCE = 1 << 18
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class WordCodes:
    """64-bit codes of words, kept for the words seen lately."""

    def __init__(self, most: int = 1 << 18) -> None:
        self._codes: dict[str, int] = {}
        self._most = most

    def __call__(self, tokens: list[str]) -> np.ndarray:
        import xxhash

        codes = self._codes
        if len(codes) > self._most:
            codes.clear()
        for w in set(tokens).difference(codes):
            codes[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))


def shingle_hashes(codes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return h


def window_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """MinHash of each run of ``width`` shingles."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = hashes[:n].copy()
    for k in range(1, width):
        np.minimum(low, hashes[k : k + n], out=low)
    return low


def _bands(min_words: int, shingle: int, name: str):
    """Distinct bands of the windows of each text (or of each part of a long one)."""
    width = min_words - shingle + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        held_ids: list[int] = []
        held: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            offsets = np.r_[0, np.cumsum([len(x) for x in held])].astype(np.int32)
            flat = np.concatenate(held).view(np.int64) if held else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(held_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=[name, "bands"])

        for batch in batches:
            for of, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = words(text.as_py()) if text.is_valid else []
                for at in range(0, len(w) - min_words + 1, PART_WORDS):
                    part = codes(w[at : at + PART_WORDS + min_words - 1])
                    held_ids.append(of)
                    held.append(np.unique(window_minima(shingle_hashes(part, shingle), width)))
                    n += len(held[-1])
                if n >= _BANDS_AT_ONCE:
                    yield out()
                    held_ids, held, n = [], [], 0
        yield out()

    return run


def holds_window(document: np.ndarray, doc_words: list[str], item: np.ndarray, item_words: list[str], min_words: int) -> bool:
    """Whether some window of the item is one of the document: by hash, then word by word."""
    there, wanted = shingle_hashes(document, min_words), shingle_hashes(item, min_words)
    for at in np.flatnonzero(np.isin(there, wanted)).tolist():
        passage = doc_words[at : at + min_words]
        if any(item_words[k : k + min_words] == passage for k in np.flatnonzero(wanted == there[at]).tolist()):
            return True
    return False


def _verify(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes()
        last: str | None = None
        doc: list[str] = []
        items: dict[str, list[str]] = {}
        for batch in batches:
            keep = []
            for text, item in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                text = text.as_py()
                if text != last:  # the candidates of a document mostly follow one another
                    last, doc = text, words(text)
                if item not in items:
                    if len(items) > 10_000:
                        items.clear()
                    items[item] = words(item)
                keep.append(holds_window(codes(doc), doc, codes(items[item]), items[item], min_words))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["doc_id", "item_id"])

    return run


def candidates(docs: DataFrame, query: DataFrame, min_words: int = MIN_WORDS, shingle: int = SHINGLE) -> DataFrame:
    """Pairs (doc_id, item_id) that share a band. The bands of the items are broadcast if they measure small, else shuffled."""
    of_items = query.mapInArrow(_bands(min_words, shingle, "item_id"), "item_id long, bands array<long>").select("item_id", F.explode("bands").alias("band")).distinct()
    of_docs = docs.mapInArrow(_bands(min_words, shingle, "doc_id"), "doc_id long, bands array<long>").select("doc_id", F.explode("bands").alias("band"))
    return of_docs.join(broadcast_if_small(of_items, []), "band").select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, shingle: int = SHINGLE) -> DataFrame:
    """Pairs (doc_id, item_id) where the document holds ``min_words`` consecutive words of the item.

    ``documents`` has doc_id and text, ``items`` item_id and item_text; other columns are ignored. Null ids give no
    pair. Null or empty texts and items of fewer words hold nothing. Repeated rows give one pair; an empty table gives
    an empty result. Whole texts are read, whatever their length, once for all items and again where a candidate is verified.
    """
    if not 1 <= shingle <= min_words:
        raise ValueError("a shingle has 1 to min_words words")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    query = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("item_text").cast("string").alias("item_text")).where("item_id is not null and item_text is not null").distinct()
    pairs = checkpointed(candidates(docs, query, min_words, shingle))
    wanted = pairs.join(broadcast_if_small(query, ["item_text"]), "item_id")
    whole = docs.join(broadcast_if_small(wanted, ["item_text"]), "doc_id").select("doc_id", "item_id", "text", "item_text")
    return whole.mapInArrow(_verify(min_words), "doc_id long, item_id long").distinct()
