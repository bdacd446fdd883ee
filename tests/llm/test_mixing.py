from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import mixing
from strandframe.llm.mixing import mix, pivot, plan_epochs, shares, token_counts

COUNTS = "doc_id long, source string, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def test_pivoting_keeps_sum_and_expectation():
    rng = np.random.default_rng(0)
    share, size = rng.random(40), rng.integers(1, 500, 40)
    hits = np.zeros(40)
    for k in range(4000):
        out, left = pivot(share, size, rng.random(40))
        assert abs((out * size).sum() - (share * size).sum()) < 1e-6
        fractional = [i for i, x in enumerate(out) if 1e-9 < x < 1 - 1e-9]
        assert fractional == ([left] if left >= 0 else [])
        hits += out
    assert np.abs(hits / 4000 - share).max() < 0.06


def test_the_scarcest_source_sets_the_size():
    e = plan_epochs({"a": 1000, "b": 100, "c": 5}, {"a": (0.5, 1), "b": (0.5, 2), "none": (0.3, 4)})
    assert e == {"a": pytest.approx(0.2), "b": pytest.approx(2.0)}
    assert plan_epochs({}, {"a": (1.0, 1)}) == {}


def docs(n=6000):
    rng = np.random.default_rng(2)
    return [(i, ["a", "a", "a", "a", "b", "c"][i % 6], int(rng.lognormal(4, 1))) for i in range(n)]


def run(spark, counts, targets, **kw):
    c = spark.createDataFrame(counts, COUNTS).withColumn("leaf", F.lit(1)).withColumn("part", F.lit("x"))
    t = spark.createDataFrame(targets, TARGETS).withColumn("copies", F.lit(9))
    sel = mix(c, t, **kw)
    return sel.collect(), {r.source: r for r in shares(sel, t).collect()}


@pytest.mark.parametrize("per_leaf", [20_000, 40])
def test_shares_and_caps(spark, monkeypatch, per_leaf):
    monkeypatch.setattr(mixing, "DOCS_PER_LEAF", per_leaf)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    counts = docs() + [(9000, None, 5), (9001, "a", 0), (9002, "x", 10), (9003, "a", None)]
    targets = [("a", 0.4, 1), ("b", 0.35, 3), ("c", 0.25, 8), ("gone", 0.2, 2)]
    sel, got = run(spark, counts, targets)
    copies = defaultdict(int)
    for r in sel:
        copies[r.doc_id] += r.copies
    assert max(copies.get(i, 0) for i, s, _ in docs() if s == "a") == 1 and max(copies.get(i, 0) for i, s, _ in docs() if s == "b") <= 3
    assert not {9000, 9001, 9002, 9003} & set(copies) and len(sel) == len(copies)
    largest = max(n for *_, n in docs())
    total = sum(r.tokens for r in got.values())
    for s, share in (("a", 0.4), ("b", 0.35), ("c", 0.25)):
        assert abs(got[s].tokens - share * total) <= 4 * largest
    assert got["gone"].tokens == 0 and got["gone"].actual_share == 0
    assert sum(r.tokens for r in got.values()) == sum(r.n_tokens * r.copies for r in sel)


def test_the_same_seed_gives_the_same_selection(spark):
    targets = [("a", 0.5, 1), ("b", 0.5, 2)]
    one, _ = run(spark, docs(900), targets, seed=5)
    two, _ = run(spark, list(reversed(docs(900))), targets, seed=5)
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))
    other, _ = run(spark, docs(900), targets, seed=6)
    assert sorted(map(tuple, one)) != sorted(map(tuple, other))


def test_equal_ids_and_empty_tables(spark):
    sel, _ = run(spark, [(1, "a", 10), (1, "a", 30), (2, "a", 30)], [("a", 1.0, 2)])
    assert sorted((r.doc_id, r.n_tokens, r.copies) for r in sel) == [(1, 30, 2), (2, 30, 2)]
    assert run(spark, [], [("a", 1.0, 2)])[0] == [] and run(spark, docs(60), [])[0] == []


def test_token_counts(spark):
    rows = [(1, "a", "Hello world"), (2, "a", ""), (3, None, None), (4, "a", "word " * 50_000), (5, "a", "<|endoftext|>")]
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("n_tokens", F.lit(-1))).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000 and got[5] > 1
