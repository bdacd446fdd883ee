"""Wiki text as a reader sees it."""

from __future__ import annotations

import html
import re
import unicodedata

# Link prefixes whose links show no label in the running text.
HIDDEN_LINKS = ("category", "kategorie", "catégorie", "categoría", "file", "image", "datei", "bild", "fichier", "archivo", "imagen")

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_EMPTY_REF = re.compile(r"<ref\b[^>]*/\s*>", re.I)
_REF = re.compile(r"<ref\b[^>]*>.*?</ref\s*>", re.I | re.S)
#: A footnote that is never closed hides its paragraph only.
_OPEN_REF = re.compile(r"<ref\b[^>]*>.*?(?=\n[ \t]*\n|\Z)", re.I | re.S)
_TABLE_LINE = re.compile(r"^[ \t]*(?:\{\|[^\n]*|\|-[^\n]*|\|\}|\|\+)", re.M)
_CELL = re.compile(r"^[ \t]*[|!]", re.M)
_CELL_ATTRIBUTES = re.compile(r"""(^[ \t]*[|!]|\|\||!!)[ \t]*(?:[a-zA-Z-]++[ \t]*+=[ \t]*+(?:"[^"|\n]*+"|'[^'|\n]*+'|[^\s|"'=!]++)[ \t]*+)++\|(?!\|)""", re.M)
_LINK = re.compile(r"\[\[([^\[\]]*)\]\]")
_EXTERNAL = re.compile(r"\[(?:https?:|ftp:)?//[^\s\[\]]*[ \t]*([^\[\]\n]*)\]")
_EMPHASIS = re.compile(r"'{2,}")
_BREAK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|dl|dd|dt|td|th|tr|hr|table|blockquote|h[1-6]|section|poem|center)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
WORD = re.compile(r"[^\W_]+")


def _label(m: re.Match) -> str:
    target, bar, label = m[1].partition("|")
    if not target.startswith(":") and target.partition(":")[0].strip().lower() in HIDDEN_LINKS and ":" in target:
        return ""
    if bar:
        return label.rpartition("|")[2] or target
    return target.removeprefix(":")


def _footnotes_out(text: str, end: int) -> str:
    """A text without footnotes; ``end`` is where its last end tag of a footnote begins, if any."""
    close = text.find(">", end) + 1 if end >= 0 else 0
    return _REF.sub("", text[:close]) + _OPEN_REF.sub("", text[close:])


def visible_text(text: str) -> str:
    """The running text: link labels without targets; no comments, footnotes, tags, emphasis or entities; table cells in turn."""
    if "<" in text:
        text = _EMPTY_REF.sub("", _COMMENT.sub("", text))
        end = text.lower().rfind("</ref")  # behind the last end of a footnote none is closed
        text = _footnotes_out(text, end)
    if "|" in text or "!" in text:
        text = _TABLE_LINE.sub(" ", _CELL_ATTRIBUTES.sub(r"\1 ", text))
    while "[[" in text:
        changed = _LINK.sub(_label, text)
        if changed == text:
            break
        text = changed
    if "[" in text:
        text = _EXTERNAL.sub(r"\1", text)
    if "''" in text:
        text = _EMPHASIS.sub("", text)
    if "<" in text:
        text = _TAG.sub("", _BREAK_TAG.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    return _INVISIBLE.sub("", text)


def words(text: str) -> list[str]:
    """Runs of letters and digits of the visible text, without case."""
    text = visible_text(text)
    return WORD.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).casefold())
