"""Texts that were cut short on their way.

Near-copies of a text are found through MinHash banding and verified (``copies``); where a copy goes on behind
the text's end, the alignment tells whether the text ends early. Texts without such a copy are scored by how they
close: by markup left open, by a sign that something was left out, and by how often the closing word's shape ends a
line of that kind anywhere in the corpus. A closing line that other documents hold as a complete line before their
end (a careless note, a template) is complete, unless markup is left open: a table's row stands in many tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.copies import CUT, matched_texts, sign_at
from strandframe.session import broadcast_if_small, checkpointed

#: A closing shape is unfinished where at most this share of its occurrences in lines of the kind ends a line.
TERMINALITY = 0.02
#: A shape counts as seen so many times more, with the share of its last mark in lines of the kind; so rare shapes follow the mark.
BACK_OFF = 2
#: A closing line is complete where it stands before the end in this share of the documents that hold it, at least.
#: So many documents are taken to be cut at any line, so that one witness is not enough for a line that ends one text.
COMPLETE_SHARE, CUT_PRIOR = 0.3, 2

_REDIRECT = re.compile(r"#(?:redirect|redirection|weiterleitung|redirección|redirec)", re.I)
_HEADING = re.compile(r"(=+)[^=\n].*?[^=\n]?\1\s*\Z")
_TAG_OPEN = re.compile(r"<(ref|blockquote|div|span|small|sub|sup|code|nowiki|gallery|table)\b[^<>]*(?<!/)>", re.I)
#: Elements that may span paragraphs; an empty one is none.
_SPAN = re.compile(r"<(/?)(ref|blockquote|div|gallery)\b[^<>]*(?<!/)>", re.I)
_WORDS_AT_ONCE = 400_000
_KINDS = ("prose", "list", "heading", "link", "template", "cell", "redirect")
#: Kinds of which the closing word tells something; the others are judged by their markup.
_WORDED = ("prose", "list")


def _balance_open(text: str, opening: str, closing: str) -> bool:
    """Whether the last ``opening`` of the text is never closed."""
    depth, at = 0, 0
    token = re.compile(re.escape(opening) + "|" + re.escape(closing))
    for m in token.finditer(text, at):
        depth = depth + 1 if m[0] == opening else max(0, depth - 1)
    return depth > 0


def open_markup(text: str) -> bool:
    """Whether a text ends inside a markup element.

    Tables, comments, footnotes, quotes, galleries and blocks may span paragraphs and are looked at in the whole text. A
    link or template left open in an earlier paragraph is the author's slip, unless the text ends in the template's parameters.
    """
    tail = text[text.rfind("\n\n") + 1 :]
    if "[[" in tail and _balance_open(tail, "[[", "]]") or "{{" in tail and _balance_open(tail, "{{", "}}"):
        return True
    if tail.endswith(("[", "{", "<")) or re.search(r"<[/a-zA-Z!][^<>\n]*\Z", tail) or re.search(r"(?<!\])\][^\]\s]*\Z", tail) and tail.count("[[") > tail.count("]]"):
        return True
    table = max(text.rfind("\n{|"), 0 if text.startswith("{|") else -1)
    if table >= 0 and not re.search(r"^[ \t]*\|\}(?!\})", text[table:], re.M):
        return True
    if text.rfind("<!--") > text.rfind("-->"):
        return True
    spans = Counter()
    for m in _SPAN.finditer(text) if "<" in text else ():
        name = m[2].lower()
        spans[name] = max(0, spans[name] - 1) if m[1] else spans[name] + 1
    if any(spans.values()):
        return True
    opened = list(_TAG_OPEN.finditer(tail)) if "<" in tail else []
    if opened and f"</{opened[-1][1].lower()}" not in tail[opened[-1].end() :].lower():
        return True
    # an emphasis left open in the last line
    last = tail[tail.rfind("\n") + 1 :]
    if last.startswith("|") and not last.startswith("|}") and "{{" in text and _balance_open(text, "{{", "}}"):
        return True
    return last.count("'''") % 2 == 1


def line_kind(line: str) -> str:
    if _REDIRECT.match(line):
        return "redirect"
    if line.startswith(("*", "#", ":", ";")):
        return "list"
    if line.startswith("="):
        return "heading"
    if line.startswith("[[") and line.find("]]") in (-1, len(line) - 2):
        return "link"
    if line.startswith("{{") or line.startswith("}}"):
        return "template"
    if line.startswith(("|", "!", "{|")):
        return "cell"
    return "prose"


def shape(word: str) -> str:
    """A word's shape: letters as a, digits as so many d (d* beyond 4), marks as they are, the last five of it."""
    s = re.sub(r"[^\W\d_]+", "a", word)
    s = re.sub(r"\d+", lambda m: "d" * len(m[0]) if len(m[0]) < 5 else "d*", s)
    return s[-5:]


def _lines(text: str) -> list[str]:
    return [x for x in (y.strip() for y in text.split("\n")) if x]


def closing_unit(line: str) -> str:
    """A line without its repetitions ("no!no!no!" as "no!"), found in linear time."""
    period = (line + line).find(line, 1)
    return line[:period].strip() if 3 <= period < len(line) else line


def _closing_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each shape ends a line, and stands inside one, by kind of line; last lines are left out."""
    ends: dict[str, Counter] = {k: Counter() for k in _KINDS}
    inside: dict[str, Counter] = {k: Counter() for k in _KINDS}

    def out() -> pa.RecordBatch:
        shapes: dict[str, str] = {}
        total: dict[tuple[str, str], list[int]] = {}
        for place, counters in enumerate((ends, inside)):
            for kind, counter in counters.items():
                for token, n in counter.items():
                    s = shapes.get(token)
                    if s is None:
                        s = shapes[token] = shape(token)
                    total.setdefault((kind, s), [0, 0])[place] += n
                counter.clear()
        keys = list(total)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k][0] for k in keys], pa.int64()), pa.array([total[k][1] for k in keys], pa.int64())],
            names=["kind", "shape", "n_end", "n_inside"],
        )

    for batch in batches:
        # words are counted as they are, and brought to their shapes once
        for text in batch.column(0).to_pylist():
            for line in _lines(text)[:-1]:
                tokens = line.split()
                kind = line_kind(line)
                ends[kind][tokens.pop()] += 1
                inside[kind].update(tokens)
        if sum(map(len, inside.values())) > _WORDS_AT_ONCE:
            yield out()
    yield out()


def closing(text: str) -> tuple[str, str, bool, bool, str]:
    """Kind of the last line, shape of its last word, sign of omission, open markup, and the closing line."""
    body = text.rstrip()
    line = body[body.rfind("\n") + 1 :].strip()
    sign = sign_at(body)
    bare = body[:sign].rstrip() if sign < len(body) else body
    last = bare[bare.rfind("\n") + 1 :].strip()
    kind = line_kind(last)
    tokens = last.split()
    s = shape(tokens[-1]) if tokens else ""
    is_open = open_markup(bare)
    if kind == "heading" and not _HEADING.match(last) or kind == "redirect" and "]]" not in last:
        is_open = True
    return kind, s, sign < len(body), is_open, closing_unit(line)


def _closings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [closing(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)] + [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.string()))],
            names=["doc_id", "kind", "shape", "sign", "open", "line"],
        )


def unfinished(texts: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id of ``texts`` whose close is unfinished, by markup, sign or closing-word terminality in ``documents``."""
    counts = documents.select("text").mapInArrow(_closing_counts, "kind string, shape string, n_end long, n_inside long")
    counts = counts.groupBy("kind", "shape").agg(F.sum("n_end").alias("n_end"), F.sum("n_inside").alias("n_inside"))
    counts = checkpointed(counts)
    mark = F.expr("right(shape, 1)")
    shapes = counts.select(F.col("kind").alias("k"), F.col("shape").alias("s"), "n_end", "n_inside")
    marks = counts.groupBy(F.col("kind").alias("mk"), mark.alias("ms")).agg((F.sum("n_end") / F.sum(F.col("n_end") + F.col("n_inside"))).alias("of_mark"))
    closings = texts.select("doc_id", "text").mapInArrow(_closings, "doc_id long, kind string, shape string, sign boolean, open boolean, line string")
    scored = closings.join(broadcast_if_small(shapes, ["k", "s"]), (F.col("kind") == F.col("k")) & (F.col("shape") == F.col("s")), "left")
    scored = scored.join(broadcast_if_small(marks, ["mk", "ms"]), (F.col("kind") == F.col("mk")) & (mark == F.col("ms")), "left")
    n_end, n_inside, of_mark = (F.coalesce(c, F.lit(0)) for c in ("n_end", "n_inside", "of_mark"))
    weak = (n_end + BACK_OFF * of_mark) / (n_end + n_inside + BACK_OFF) <= TERMINALITY
    suspects = scored.where("line <> ''").where(F.col("open") | F.col("sign") | (weak & F.col("kind").isin(*_WORDED)))
    suspects = checkpointed(suspects.select("doc_id", "open", F.xxhash64("line").alias("h")))
    # what closes by its word or sign alone may be a line that stands complete before the end of other documents
    closed = suspects.where(~F.col("open"))
    ended = closed.groupBy("h").agg(F.countDistinct("doc_id").alias("n_end"))
    complete = documents.select("doc_id", F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("ls"))
    complete = complete.select("doc_id", F.explode(F.transform(F.slice("ls", 1, F.greatest(F.size("ls") - 1, F.lit(0))), lambda x: F.xxhash64(x))).alias("h"))
    witnesses = complete.join(ended.select("h"), "h", "left_semi").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    witnesses = witnesses.join(ended, "h").where(F.col("n") >= COMPLETE_SHARE * (F.col("n") + F.col("n_end") + CUT_PRIOR))
    return suspects.where("open").select("doc_id").unionByName(closed.join(witnesses, "h", "left_anti").select("doc_id"))


def truncated(documents: DataFrame) -> DataFrame:
    """Documents whose text stops before its page did: ``doc_id``, ``by_copy``, ``by_close``.

    ``documents`` has doc_id and text; other columns are ignored. Null ids and null, empty or blank texts give no
    row; rows of one id are judged each and reported once. Whole texts are read, and all statistics are of all documents.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and trim(text) <> ''")
    docs = docs.withColumn("id", F.xxhash64("text"))
    matched = checkpointed(matched_texts(docs.select("id", "text")))
    known = broadcast_if_small(matched, [])
    by_copy = docs.join(known.where(F.col("verdict") == CUT), "id", "left_semi").select("doc_id", F.lit(True).alias("a"), F.lit(False).alias("b"))
    rest = docs.join(known, "id", "left_anti").select("doc_id", "text")
    by_close = unfinished(rest, docs).select("doc_id", F.lit(False).alias("a"), F.lit(True).alias("b"))
    return by_copy.unionByName(by_close).groupBy("doc_id").agg(F.max("a").alias("by_copy"), F.max("b").alias("by_close"))


def rate_per_source(documents: DataFrame, found: DataFrame) -> DataFrame:
    """``source``, documents, truncated documents and their rate; a null source is a source of its own."""
    ids = found.select(F.col("doc_id").alias("cut_id"))
    marked = documents.select("source", "doc_id").join(ids, F.col("doc_id") == F.col("cut_id"), "left")
    out = marked.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("cut_id").alias("n_truncated"))
    return out.withColumn("rate", F.col("n_truncated") / F.col("n"))
