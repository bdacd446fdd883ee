import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import cooccurrence
from strandframe.llm.cooccurrence import pair_counts

SCHEMA = "grp string, item string, basket string"


def brute(rows):
    baskets = defaultdict(set)
    for g, i, b in rows:
        if None not in (g, i, b):
            baskets[g, b].add(i)
    n, one, both = defaultdict(int), defaultdict(int), defaultdict(int)
    for (g, _), items in baskets.items():
        n[g] += 1
        for i in items:
            one[g, i] += 1
        for a, b in combinations(sorted(items), 2):
            both[g, a, b] += 1
    return {(g, a, b): (k, one[g, a], one[g, b], n[g]) for (g, a, b), k in both.items()}


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit(1)).withColumn("n", F.lit(2)).repartition(3)
    out = pair_counts(df).collect()
    assert len(out) == len({(r.grp, r.item_a, r.item_b) for r in out})
    return out


def as_dict(rows):
    return {(r.grp, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n) for r in rows}


@pytest.mark.parametrize("at_once", [1 << 20, 7])
def test_equals_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(cooccurrence, "CODES_AT_ONCE", at_once)
    rng = random.Random(1)
    rows = [(rng.choice(["g1", "g2", None]), f"i{int(rng.expovariate(0.2))}", f"b{rng.randrange(60)}") for _ in range(1500)]
    rows += [("g1", None, "b1"), ("g1", "x", None), ("g1", "", "b1"), ("g1", "", "b2")]
    assert as_dict(run(spark, rows)) == brute(rows)


def test_a_hot_basket_and_a_large_one(spark):
    rows = [("g", "a", "hot")] * 2000 + [("g", "b", "hot")] * 2000 + [("g", f"i{k:03}", "large") for k in range(300)]
    assert as_dict(run(spark, rows)) == brute(rows)


def test_ratios(spark):
    rows = [("g", "a", str(k)) for k in range(6)] + [("g", "b", str(k)) for k in range(4)] + [("g", "c", "9")]
    r = next(x for x in run(spark, rows) if x.item_b == "b")
    assert r.lift == pytest.approx(4 * 7 / (6 * 4)) and r.odds_ratio == pytest.approx(4.5 * 1.5 / (2.5 * 0.5))


def test_no_pairs(spark):
    assert run(spark, []) == [] and run(spark, [("g", "a", "1"), ("g", "a", "1"), ("h", "b", "1")]) == []


def test_large_groups_are_paired_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "ITEMS_PER_CHUNK", 16)
    rng = random.Random(2)
    rows = [("g", f"i{rng.randrange(90)}", f"b{int(rng.expovariate(0.1))}") for _ in range(1500)] + [("h", f"i{rng.randrange(9)}", f"b{rng.randrange(9)}") for _ in range(60)]
    assert as_dict(run(spark, rows)) == brute(rows)


def test_items_beyond_32_bits_keep_their_pairs():
    a, b = np.array([1, 1 << 33, (1 << 32) - 1, 5]), np.array([2, (1 << 33) + 1, 1 << 40, 1 << 32])
    upper, code = cooccurrence._packed(a, b)
    low = np.int64((1 << 32) - 1)
    back = lambda up, x: (up << 32) | x
    assert (back((upper >> 32) & low, (code >> 32) & low) == a).all() and (back(upper & low, code & low) == b).all()
    counted = cooccurrence._count_runs(np.r_[upper, upper], np.r_[code, code], np.ones(8, np.int64))
    assert len(counted[0]) == 4 and (counted[2] == 2).all()
