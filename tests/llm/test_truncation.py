import random

import pytest
from pyspark.sql import functions as F

from strandframe.llm.copies import COMPLETE, CUT, NOT_ALIKE, head_sizes, matched_texts, similarity, verdict
from strandframe.llm.truncation import closing, closing_unit, open_markup, rate_per_source, shape, truncated

NOUNS = "mill tower harbour bridge school orchard quarry market".split()


def page(rng, n=6):
    lines = ["'''Town''' is a small place by the sea. It has a " + rng.choice(NOUNS) + " from 1820.", "== History =="]
    for _ in range(n):
        lines.append(" ".join(f"The {rng.choice(NOUNS)} of {rng.choice(NOUNS).title()}{rng.randrange(999)} was built in {rng.randrange(1700, 2000)} by {rng.choice(NOUNS)} keepers." for _ in range(3)))
        if rng.random() < 0.05:
            lines.append("no idea who wrote this lol")
        if rng.random() < 0.4:
            lines += [f"* {rng.choice(NOUNS).title()}, {rng.randrange(1700, 2000)}" for _ in range(3)]
    end = rng.choice(["[[Category:Town mills]]", "{{stub}}", "* Old mill, 1802", '{| class="w"\n| a || 1\n|}', "no idea who wrote this lol", "All is said.", "== Notes =="])
    return "\n\n".join([*lines, end])


@pytest.mark.parametrize(
    "text",
    ["a [[Cat", "a {{x|y", "{| class=x\n| a", "x <!-- y", "x <ref>Foo", "x '''bold", "end <re", "[[Category:Foo]", "a\n\n{", "#REDIRECT [[Fo"],
)
def test_open_markup(text):
    assert open_markup(text)


@pytest.mark.parametrize("text", ["[[a]] {{b}}", "{|\n| a\n|}", "x <!-- y --> z.", "x<ref>Foo</ref>", "{{#if:{{{p|}}}|x}}", "{{{lead}}}", "a [[slip\n\nNext one."])
def test_closed_markup(text):
    assert not open_markup(text)


def test_shapes_units_and_closings():
    assert shape("Foo,") == "a," and shape("1906") == "dddd" and shape("123456") == "d*"
    assert closing_unit("no way!no way!no way!") == "no way!" and closing_unit("a b") == "a b"
    kind, s, sign, is_open, line = closing("One.\n\n* Old mill, 18 [...]\n")
    assert (kind, s, sign, is_open, line) == ("list", "dd", True, False, "* Old mill, 18 [...]")


def test_alignment():
    long = "The first line is here to stay. The second sentence goes on for a while and then it ends.\n\nMore."
    assert all(verdict(x, long) == CUT for x in (long[:70], long[:70] + " [...]", long[:68] + "…", long.split("\n")[0] + " [...]"))
    assert all(verdict(x, long) == COMPLETE for x in (long[:31], long.split("\n")[0]))
    assert verdict("Something else entirely, not there at all.", long) == NOT_ALIKE == verdict(long, long) == verdict("Other words stand before, many of them. " + long[:70], long)
    assert verdict(long[:31], long, open_markup=True) == CUT
    assert similarity(long, long) == 1.0 and similarity(long, "x") == 0.0


def corpus(spark, n=400):
    rng = random.Random(1)
    rows, cut = [], set()
    for i in range(n):
        text = page(rng)
        if i % 5 == 0:
            # a cut in the middle of a word of prose
            at = next(k for k in range(int(len(text) * rng.uniform(0.85, 0.95)), 0, -1) if text[k - 1].isalpha() and text[k].isalpha() and text[k - 2].isalpha())
            rows.append((1000 + i, "a", text))
            text = text[:at] + rng.choice(["", "…", " [...]"])
            cut.add(i)
        rows.append((i, ["a", "b"][i % 2], text))
    rows += [(5000, None, None), (5001, "b", ""), (5002, "b", "  \n"), (5003, "b", "long " * 100_000 + "end.")]
    return spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("h", F.lit(1)).withColumn("bucket", F.lit("x")), cut


def test_cut_texts_are_found_and_others_are_not(spark):
    df, cut = corpus(spark)
    rows = truncated(df).collect()
    found = {r.doc_id for r in rows}
    assert len(rows) == len(found)
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.03 * len(cut)
    assert any(r.by_copy for r in rows)
    rates = {r.source: (r.n, r.n_truncated) for r in rate_per_source(df, truncated(df)).collect()}
    assert sum(t for _, t in rates.values()) == len(found) and rates[None] == (1, 0)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert truncated(df).count() == 0 and rate_per_source(df, truncated(df)).count() == 0


def test_a_hot_group_of_copies(spark):
    rng = random.Random(2)
    text = page(rng, 10)
    rows = [(i, "a", text) for i in range(500)] + [(900, "a", text[: text.index("keepers", len(text) - 260) + 3])] + [(1000 + i, "b", page(rng)) for i in range(50)]
    found = {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("by_copy").collect()}
    assert found == {900}


def test_a_cut_at_a_row_edge_of_a_table_has_no_witnesses(spark):
    rng = random.Random(3)
    table = '{| class="w"\n! Year !! Place\n|-\n| 1966 || Ham\n|-\n| 1967 || Dale\n|}'
    rows = [(i, "a", page(rng) + "\n\n" + table + f"\n\n[[Category:Mills {i % 7}]]") for i in range(60)]
    base = page(rng) + "\n\n"
    rows += [(900, "a", base + table[: table.index("|-") + 2]), (901, "a", base + table[: table.index("Ham") + 3]), (902, "a", base + table)]
    found = {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert {900, 901} <= found and 902 not in found


def test_witnesses_count_against_the_texts_that_a_line_ends(spark):
    rng = random.Random(4)
    note, cut = "no idea who wrote this lol...", "The mill of the old harbour and..."
    text = lambda *lines: "\n\n".join([page(rng), *lines])
    rows = [(i, "a", text(note, "All is said.")) for i in range(20)] + [(100 + i, "a", text(note)) for i in range(20)]
    rows += [(200 + i, "a", text(cut, "All is said.")) for i in range(2)] + [(300 + i, "a", text(cut)) for i in range(40)]
    found = {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("by_close").collect()}
    assert not found & set(range(100, 120)) and set(range(300, 340)) <= found


def test_a_copy_is_compared_with_every_longer_member_of_its_bucket(spark):
    text = page(random.Random(5), 40)
    at = text.index("keepers", len(text) - 900) + 3
    # the longest copy goes on in other words behind the cut, the next one as the page did
    longest = text[: at - 25] + "\n\n" + "la " * 600
    assert similarity(text[:at], longest) >= 0.8 and similarity(text[:at], text) >= 0.8 and len(longest) > len(text)
    rows = [(1, "a", text[:at]), (2, "a", text), (3, "b", longest), (4, "b", longest), (5, "b", text[:at])]
    found = {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("by_copy").collect()}
    assert found == {1, 5}


def test_a_rare_closing_shape_is_judged_alike_in_corpora_of_any_size(spark):
    # two dots end one other line in the small corpus and four in the large; a comma ends none
    def found(n):
        rng = random.Random(6)
        rows = [(i, "a", page(rng) + "\n\n" + ("The tower fell.." if i % 60 == 7 else "All is said.") + "\n\nThe end.") for i in range(n)]
        rows += [(900, "a", page(rng) + "\n\nThe bridge was sold.."), (901, "a", page(rng) + "\n\nThe bridge was sold_,")]
        return {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()} & {900, 901}

    assert found(60) == found(240) == {901}


@pytest.mark.parametrize("text", ["x<ref>One.\n\nTwo.", "<blockquote>One.\n\nTwo.", "<div>\n\n<div>a</div>\n\nTwo.", "<gallery>\nA.jpg\n\nB.jpg", "{{Box\n| a = 1\n\n| b = 2"])
def test_elements_that_span_paragraphs_are_open(text):
    assert open_markup(text)


@pytest.mark.parametrize("text", ["{{Box\n| a = 1\n\nThe page goes on.", "{{slip\n\n{|\n| a\n|}", "x<ref name=a/>.\n\nTwo.", "<div>One.\n\nTwo.</div>\n\nEnd."])
def test_slips_and_closed_elements_are_not_open(text):
    assert not open_markup(text)


def cut_corpus(n=120):
    """Pages with several revisions, and texts cut from some of them at any depth."""
    rng = random.Random(11)
    texts = {}
    for i in range(n):
        text = page(rng, rng.choice([2, 6, 15]))
        words = text.split(" ")
        for r in range(rng.choice([1, 2, 3])):
            edited = " ".join(rng.choice(NOUNS) if rng.random() < 0.01 * r else w for w in words) + rng.choice(["", "\n\nAnd so on.", "\n\n* One more, 1900"])
            texts[i * 10 + r] = edited
        if i % 2:
            whole = texts[i * 10]
            texts[i * 10 + 9] = whole[: rng.randrange(min(90, len(whole) - 2), len(whole) - 1)] + rng.choice(["", "", "…", " [...]"])
    return texts


def test_recall_against_brute_force(spark):
    """All pairs are compared here; the operator must match the same texts, but for what its signatures miss."""
    texts = cut_corpus()
    want = {}
    for a, x in texts.items():
        for b, y in texts.items():
            if a != b and x != y and a // 10 == b // 10 and len(y) > len(x.rstrip()) - 40:
                v = verdict(x, y, open_markup(x.rstrip()))
                want[x] = max(want.get(x, 0), v)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("id", F.xxhash64("text"))
    by_id = {r.id: r.text for r in df.collect()}
    got = {by_id[r.id]: r.verdict for r in matched_texts(df.select("id", "text")).collect()}
    cut = {x for x, v in want.items() if v == CUT}
    found = {x for x, v in got.items() if v == CUT}
    assert len(cut) >= 50 and len(found & cut) >= 0.95 * len(cut) and found <= cut
    # how deep a cut is doesn't matter
    deep = {texts[i] for i in texts if i % 10 == 9 and len(texts[i]) < 0.3 * len(texts[i - 9]) and texts[i] in cut}
    assert len(deep) >= 5 and len(found & deep) >= 0.9 * len(deep)


def test_cuts_that_only_a_copy_shows_are_found(spark):
    rng = random.Random(12)
    whole = page(rng, 8) + "\n\n* Old kiln, 1697\n* New kiln, 1802\n\nAll is said."
    rows = [(i, "a", page(rng)) for i in range(80)] + [(900, "a", whole), (901, "b", whole[: whole.index("1697") + 2]), (902, "b", whole[: whole.index("1697") + 4])]
    rows = truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("doc_id >= 900").collect()
    assert {(r.doc_id, r.by_copy, r.by_close) for r in rows} == {(901, True, False)}


def test_head_sizes():
    assert head_sizes(3) == [] and head_sizes(4) == [4] and head_sizes(100) == [4, 16, 64]


def test_a_hot_page_of_revisions(spark):
    rng = random.Random(13)
    base = page(rng, 12)
    rows = [(i, "a", base + f"\n\n* Mill number {i}, {1700 + i}\n\nAll is said.") for i in range(400)]
    cut = base + "\n\n* Mill number 17, 17"
    rows += [(900, "b", cut), (901, "b", base[: base.index("keepers", len(base) // 2) + 3])]
    found = {r.doc_id for r in truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).where("by_copy").collect()}
    assert found == {900, 901}
