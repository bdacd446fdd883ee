"""Mixing of sources to target weights.

Each document gets an expected number of copies; the whole part is given, and the fractional part is
rounded by pivotal sampling: two documents with fractional copies meet, a random transfer of mass,
weighted by their tokens, makes one of them integral and keeps both the expected copies and the sum of
tokens. What stays fractional in a leaf (one document a source) moves up a reduction tree. So the tokens of
a source come out within one document of their target.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import checkpointed

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-tokenizer's pattern that goes with the byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DOCS_PER_LEAF, FAN_IN = 20_000, 64
_EPS = 1e-9


def _tokens(vocabulary: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            n = [len(bpe.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source and tokens of each whole text by a public tokenizer; a null or empty text has none.

    ``tokenizer`` is the path of its vocabulary at the driver, from where the session brings the file to the workers.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    src = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_tokens(os.path.basename(tokenizer), pattern), "doc_id long, source string, n_tokens long")


def plan_epochs(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Expected copies per document of each source.

    The mixture is as large as the scarcest source allows: source s gives share_s of the total and at most
    max_repeats_s times its own tokens. Sources with a target but no tokens can't give their share; the other
    shares are scaled to make up the whole. Sources without a target give nothing.
    """
    usable = {s: (share, cap) for s, (share, cap) in targets.items() if tokens.get(s, 0) > 0 and share > 0 and cap > 0}
    whole = sum(share for share, _ in usable.values())
    if not whole:
        return {}
    total = min(cap * tokens[s] / (share / whole) for s, (share, cap) in usable.items())
    return {s: min(float(cap), total * (share / whole) / tokens[s]) for s, (share, cap) in usable.items()}


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """A number in [0, 1) for each document, the same on every run."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2 + 1) * np.uint64(0xD1342543DE82EF95)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def pivot(share: np.ndarray, size: np.ndarray, luck: np.ndarray) -> tuple[np.ndarray, int]:
    """Round all but one of the fractional ``share``; returns the result and the place still open (-1: none).

    Between i and j mass moves so that size_i * share_i + size_j * share_j stays; the direction is drawn with the
    odds that keep the expectation of each.
    """
    out = share.astype(np.float64).copy()
    i = -1
    for j in np.flatnonzero((out > _EPS) & (out < 1 - _EPS)).tolist():
        if i < 0:
            i = j
            continue
        a, b, ratio = out[i], out[j], size[i] / size[j]
        # up: i gains until i is 1 or j is 0; down: i loses until i is 0 or j is 1
        up, down = min(1 - a, b / ratio), min(a, (1 - b) / ratio)
        move = up if luck[j] < down / (up + down) else -down
        out[i], out[j] = a + move, b - move * ratio
        open_i, open_j = _EPS < out[i] < 1 - _EPS, _EPS < out[j] < 1 - _EPS
        i = i if open_i else j if open_j else -1
    return out, i


def _round(seed: int, last: bool):
    """Pivot each run of equal (source, leaf); rows keep their share, decided ones have 0 or 1."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        share, size = rows.column("part").to_numpy().copy(), rows.column("n_tokens").to_numpy()
        ids = rows.column("doc_id").to_numpy()
        luck = _uniform(ids, seed)
        source = rows.column("source").to_pylist()
        leaf = rows.column("leaf").to_numpy()
        heads = [0] + [k for k in range(1, len(ids)) if source[k] != source[k - 1] or leaf[k] != leaf[k - 1]]
        for a, b in zip(heads, [*heads[1:], len(ids)], strict=True):
            share[a:b], left = pivot(share[a:b], size[a:b], luck[a:b])
            if last and left >= 0:
                share[a + left] = float(_uniform(ids[a + left : a + left + 1], seed + 1)[0] < share[a + left])
        done = (share <= _EPS) | (share >= 1 - _EPS)
        share[done] = np.round(share[done])
        return pa.RecordBatch.from_arrays(
            [rows.column("source").combine_chunks(), rows.column("leaf").combine_chunks(), rows.column("doc_id").combine_chunks(), rows.column("n_tokens").combine_chunks(), pa.array(share), pa.array(done)],
            names=["source", "leaf", "doc_id", "n_tokens", "part", "done"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, t]) if held is not None else t
            tail = (held.column("source")[-1].as_py(), held.column("leaf")[-1].as_py())
            source, leaf = held.column("source").to_pylist(), held.column("leaf").to_pylist()
            k = len(leaf)
            while k and (source[k - 1], leaf[k - 1]) == tail:
                k -= 1
            if k:
                yield settle(held.slice(0, k))
                held = held.slice(k)
        if held is not None and held.num_rows:
            yield settle(held)

    return run


_ROUNDED = "source string, leaf long, doc_id long, n_tokens long, part double, done boolean"


def mix(counts: DataFrame, targets: DataFrame, seed: int = 17) -> DataFrame:
    """Copies of each selected document: ``doc_id, source, n_tokens, copies``; documents with no copy have no row.

    ``counts`` has doc_id, source, n_tokens; ``targets`` has source, target_share, max_repeats, one row a source (of
    repeated rows the largest share and the least cap hold). No document has more than max_repeats copies. Rows of
    ``counts`` without an id, a source, a target or tokens give no row; of rows with equal ids the one of most tokens counts. ``targets``
    is a configuration of few rows and is read by the driver.
    """
    wanted = {r.source: (float(r.share), int(r.cap)) for r in targets.where("source is not null and target_share is not null and max_repeats is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.min("max_repeats").alias("cap")).collect()}
    known = counts.where("doc_id is not null and source is not null and n_tokens > 0")
    known = known.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("d")).select("doc_id", "d.source", "d.n_tokens")
    docs = checkpointed(known)
    docs = docs.where(F.col("source").isin(list(wanted)))
    sums = {r.source: (r.tokens, r.n) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()}
    epochs = plan_epochs({s: t for s, (t, _) in sums.items()}, wanted)
    spark = docs.sparkSession
    plan = spark.createDataFrame(list(epochs.items()) or [("", 0.0)], "of string, epochs double")
    leaves = max(1, -(-max([n for _, n in sums.values()], default=0) // DOCS_PER_LEAF))
    rows = docs.join(F.broadcast(plan), F.col("source") == F.col("of")).select(
        "source", F.pmod(F.xxhash64("doc_id"), F.lit(leaves)).alias("leaf"), "doc_id", "n_tokens", F.floor(F.col("epochs") + _EPS).cast("long").alias("whole"), (F.col("epochs") - F.floor(F.col("epochs") + _EPS)).alias("part")
    )
    whole = rows.where("whole > 0").select("doc_id", "source", "n_tokens", F.col("whole").alias("copies"))
    level, parts = rows.where(F.col("part") > _EPS).drop("whole"), []
    k = 0
    while True:
        last = leaves == 1
        settled = (
            level.repartition("source", "leaf").sortWithinPartitions("source", "leaf", "n_tokens", "doc_id").select("source", "leaf", "doc_id", "n_tokens", "part").mapInArrow(_round(seed + 2 * k, last), _ROUNDED)
        )
        if not last:
            settled = checkpointed(settled)
        parts.append(settled.where("done and part > 0.5"))
        if last:
            break
        leaves, k = -(-leaves // FAN_IN), k + 1
        level = settled.where("not done").withColumn("leaf", F.floor(F.col("leaf") / FAN_IN).cast("long")).drop("done")
    for p in parts:
        whole = whole.unionByName(p.select("doc_id", "source", "n_tokens", F.lit(1).cast("long").alias("copies")))
    one_row = whole.groupBy("doc_id", "source", "n_tokens").agg(F.sum("copies").alias("copies"))
    return one_row


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source with a target or a selected document: target and actual share, tokens, documents and copies."""
    got = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"))
    out = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share")).join(got, "source", "full_outer")
    # one row a source: a window over all of them is small
    out = out.withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("all_tokens")).alias("actual_share"), zero("tokens"), zero("n_documents"), zero("n_copies"))
