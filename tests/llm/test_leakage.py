import random

import pytest
from pyspark.sql import functions as F

from strandframe.llm.leakage import leaked_items, window_minima
from strandframe.llm.markup import visible_text, words

WORDS = [f"w{i}" for i in range(400)]


@pytest.mark.parametrize(
    ("text", "seen"),
    [
        ("[[a b|c d]] e", "c d e"),
        ("[[Tuna]]s and [[:Category:x y]]", "Tunas and Category x y"),
        ("x[[Category:a b]]y [[File:q.png|thumb|cap]] z", "xy z"),
        ("a<!-- b c -->d <ref name=x>e f</ref>g<ref name=x/> h", "ad g h"),
        ("a ''b'' '''c'''d", "a b cd"),
        ("a&nbsp;b &amp; &eacute;t&eacute; co&shy;op", "a b été coop"),
        ("a<br/>b<b>c</b>d <blockquote>e</blockquote>", "a bcd e"),
        ('{| class="wikitable"\n! h || i\n|-\n| a b || c\n| style="x" | d\n|}\ne', "h i a b c d e"),
        ("[http://x.y/z the label] [https://q.r]", "the label"),
        ("cut <!-- open", "cut"),
        ("a<ref>b</ref> c<ref>d e\nf\n\ng h", "a c g h"),
        ("A-b_c's Straße 12", "a b c s strasse 12"),
    ],
)
def test_what_a_reader_sees(text, seen):
    assert words(text) == words(seen)


def test_nested_links():
    assert visible_text("[[File:a|b [[c|d]] e]] f").split() == ["f"]


def brute(docs, items, n=12):
    out = set()
    for i, text in items:
        w = words(text or "")
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for d, doc in docs:
            v = words(doc or "")
            if any(tuple(v[k : k + n]) in grams for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(-1)).withColumn("item_text", F.lit("clash"))
    i = spark.createDataFrame(items, "item_id long, item_text string").withColumn("doc_id", F.lit(-1)).withColumn("text", F.lit("clash"))
    rows = [tuple(r) for r in leaked_items(d, i, **kw).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 60)))) for i in range(30)]
    items += [(90, items[0][1]), (91, items[1][1] + " tail words"), (92, None), (93, "")]
    docs = []
    for d in range(300):
        w = [rng.choice(WORDS) for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.6:
            q = (rng.choice(items[:30])[1]).split()
            n = rng.choice([10, 11, 12, 13, 20, len(q)])
            at = rng.randrange(0, max(1, len(q) - n + 1))
            quote = q[at : at + n]
            if rng.random() < 0.3:
                quote = [f"[[x|{x.upper()}]]" if rng.random() < 0.3 else f"{x}<ref>no {x}</ref>" for x in quote]
            k = rng.randrange(0, len(w) + 1)
            w[k:k] = quote
        docs.append((d, " ".join(w)))
    return docs + [(900, None), (901, ""), (902, "short"), (0, docs[0][1])], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = corpus(seed)
    assert run(spark, docs, items) == brute(docs, items)


def test_long_texts_in_parts_and_many_bands(spark, monkeypatch):
    from strandframe.llm import leakage

    docs, items = corpus(3)
    monkeypatch.setattr(leakage, "PART_WORDS", 20)
    monkeypatch.setattr(leakage, "_BANDS_AT_ONCE", 50)
    assert run(spark, docs, items) == brute(docs, items)


def test_without_broadcast(spark, monkeypatch):
    from strandframe.llm import leakage

    docs, items = corpus(5)
    monkeypatch.setattr(leakage, "broadcast_if_small", lambda df, columns: df)
    assert run(spark, docs, items) == brute(docs, items)


def test_candidates_that_share_a_shingle_only_are_refused(spark):
    lead = "which of the following statements about the old harbour is"
    docs = [(1, lead + " not known to anyone in the town today at all"), (2, lead + " true of every boat that has ever landed here")]
    assert run(spark, docs, [(7, lead + " true of every boat that has ever sunk")]) == {(2, 7)}


def test_other_lengths_and_empty_tables(spark):
    docs, items = corpus(4)
    assert run(spark, docs, items, min_words=8, shingle=3) == brute(docs, items, 8)
    assert run(spark, [], items) == set() and run(spark, docs, []) == set()
    with pytest.raises(ValueError):
        run(spark, docs, items, min_words=4)


def test_a_very_long_text(spark):
    item = " ".join(WORDS[:15])
    assert run(spark, [(1, "lorem " * 300_000 + item)], [(1, item)]) == {(1, 1)}


def test_equal_windows_have_equal_minima():
    import numpy as np

    h = np.random.default_rng(0).integers(0, 2**63, 100).astype(np.uint64)
    assert window_minima(h, 8).tolist() == [h[k : k + 8].min() for k in range(93)]
    assert len(window_minima(h[:7], 8)) == 0


@pytest.mark.parametrize("piece", ["[[", "[http://a ", "<a ", "!!a=", "|| a=b c=d ", "''", "{|", "<ref>", "<!--"])
def test_markup_is_read_in_linear_time(piece):
    import time

    began = time.perf_counter()
    words(piece * 20_000)
    assert time.perf_counter() - began < 10
