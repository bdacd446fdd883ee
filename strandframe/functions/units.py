"""Units of recorded quantities, read from text.

A phrase is cut into known pieces by dynamic programming over tries of prefixes ("per", "times", "milli"),
roots ("cent", "mille", "byte", "phred") and exponents ("^", "³"), beside numbers, endings, and words that
name a field or turn and part a statement. Pieces are then composed: "per" and "cent", "times" and "1000", "0",
"to" and "255", "10", "^" and "4", "8" and "bit" each make a scale, of any size. Letters that can be read in
several ways ("ml" is a millilitre or the tag of modification likelihoods) have a reading for each
dimension, and the prior of the dimension of the field that is asked for decides.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from functools import lru_cache

#: Units of a probability that have a name; other scales are named after their end ("per_10000"). Phred is not linear.
UNITS = ("fraction", "percent", "permille", "byte", "phred")
_BY_SCALE = {1: "fraction", 100: "percent", 255: "byte", 1000: "permille"}

# Spellings and what they stand for.
#: A prefix says how what follows makes a unit: a ratio to it, a factor, a divisor, or a power of ten.
PREFIXES = {
    "per": ("ratio", None), "pour": ("ratio", None), "por": ("ratio", None), "pro": ("ratio", None), "pp": ("ratio", None), "out of": ("ratio", None), "in": ("in", None),
    "x": ("times", None), "×": ("times", None), "*": ("times", None), "times": ("times", None), "multiplied by": ("times", None), "scaled to": ("times", None), "scaled by": ("times", None),
    "divided by": ("divide", None), "divided": ("divide", None), "/": ("slash", None),
    "deci": ("power", 1), "centi": ("power", 2), "milli": ("power", 3), "micro": ("power", 6),
}
#: A root that needs a prefix or an ending ("cent", "thousand"), or that is a unit by itself ("byte").
ROOTS = {
    "cent": ("root", 100), "zent": ("root", 100), "ciento": ("root", 100), "hundred": ("root", 100), "mille": ("root", 1000), "mil": ("root", 1000), "thousand": ("root", 1000),
    "ten thousand": ("root", 10_000), "million": ("root", 1_000_000), "m": ("root", 1_000_000), "billion": ("root", 1_000_000_000), "b": ("root", 1_000_000_000),
    "%": ("unit", 100), "pct": ("unit", 100), "‰": ("unit", 1000), "‱": ("unit", 10_000), "byte": ("unit", 255), "fraction": ("unit", 1), "proportion": ("unit", 1), "unit interval": ("unit", 1), "p=": ("unit", 1),
    "phred": ("unit", "phred"), "q": ("unit", "phred"), "qv": ("unit", "phred"), "q-score": ("unit", "phred"), "log10(1-p)": ("unit", "phred"), "log(1-p)": ("unit", "phred"),
    "bit": ("bits", None), "uint": ("uint", None),
}
EXPONENTS = {"^": ("power of", None), "**": ("power of", None), "¹": ("raised", 1), "²": ("raised", 2), "³": ("raised", 3), "⁴": ("raised", 4), "⁵": ("raised", 5), "⁶": ("raised", 6)}
ENDINGS = {"s": ("ending", ""), "age": ("ending", ""), "ages": ("ending", ""), "th": ("part of", ""), "ths": ("part of", "")}
WORDS = {
    "prob": ("field", "prob"), "probs": ("field", "prob"), "probability": ("field", "prob"), "probabilities": ("field", "prob"), "likelihood": ("field", "prob"), "likelihoods": ("field", "prob"),
    "ml": ("field", "qual"), "list": ("field", "qual"), "lists": ("field", "qual"), "quality": ("field", "qual"), "qualities": ("field", "qual"), "qual": ("field", "qual"), "quals": ("field", "qual"),
    "m5c": ("field", "m5c_qual"), "5mc": ("field", "m5c_qual"), "m6a": ("field", "m6a_qual"), "6ma": ("field", "m6a_qual"),
    "all": ("all", ""), "every": ("all", ""), "both": ("all", ""), "everything": ("all", ""), "value": ("value", ""), "values": ("value", ""), "call": ("value", ""), "calls": ("value", ""), "scaled": ("value", ""),
    "not": ("not", ""), "never": ("not", ""), "without": ("not", ""), "untouched": ("keep", ""), "unchanged": ("keep", ""), "kept": ("keep", ""), "as is": ("keep", ""),
    ",": ("part", ""), ";": ("part", ""), ".": ("stop", ""), "while": ("part", ""), "but": ("part", ""), "whereas": ("part", ""), "and": ("join", ""), "of": ("of", ""),
    "to": ("range", ""), "-": ("range", ""), "–": ("range", ""), "..": ("range", ""), "…": ("range", ""), "parts": ("other", ""), "raw": ("other", ""), "=": ("other", ""),
}
#: Readings of the same letters in other dimensions.
OTHER_READINGS = {"ml": ("volume", "millilitre"), "q": ("charge", "coulomb"), "mil": ("length", "thou"), "m": ("length", "metre"), "b": ("length", "base"), "bit": ("information", "bit"), "byte": ("information", "byte"), "x": ("depth", "coverage"), "list": ("information", "list")}
#: Log prior of each dimension of a reading, by the dimension of the field that is asked for.
PRIORS = {
    "probability": {"probability": 0.0, "volume": -6.0, "charge": -6.0, "length": -6.0, "information": -4.0, "depth": -5.0},
    "volume": {"probability": -6.0, "volume": 0.0, "charge": -8.0, "length": -6.0, "information": -6.0, "depth": -6.0},
    "length": {"probability": -6.0, "volume": -6.0, "charge": -8.0, "length": 0.0, "information": -6.0, "depth": -5.0},
}
_LETTER_COST, _LETTER_GAIN, _PIECE_COST, _MARK_COST = 1.0, 0.5, 0.4, 0.05
_FIELDS = {"prob": ("prob",), "qual": ("m5c_qual", "m6a_qual"), "m5c_qual": ("m5c_qual",), "m6a_qual": ("m6a_qual",)}
OWN_UNIT = {"prob": "fraction", "m5c_qual": "byte", "m6a_qual": "byte"}
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?(?:e[-+]?[0-9]+)?")


@dataclass
class _Node:
    next: dict[str, _Node] = field(default_factory=dict)
    readings: list[tuple[str, object, str]] = field(default_factory=list)


@dataclass(frozen=True)
class Piece:
    kind: str
    value: object
    start: int
    end: int


def _trie(words: dict[str, tuple[str, object]]) -> _Node:
    root = _Node()
    for text, (kind, value) in words.items():
        node = root
        for ch in text:
            node = node.next.setdefault(ch, _Node())
        node.readings.append((kind, value, "probability"))
        if text in OTHER_READINGS:
            dimension, name = OTHER_READINGS[text]
            node.readings.append(("foreign", name, dimension))
    return root


_TRIES = {"prefix": _trie(PREFIXES), "root": _trie(ROOTS), "exponent": _trie(EXPONENTS), "ending": _trie(ENDINGS), "word": _trie(WORDS)}


def _edge(text: str, at: int) -> bool:
    """Whether a word may begin or end here; letters and digits part."""
    return not 0 < at < len(text) or not (text[at - 1].isalnum() and text[at].isalnum()) or text[at - 1].isdigit() != text[at].isdigit()


def _fits(text: str, i: int, j: int, trie: str) -> bool:
    """Whether a piece may stand here: whole words, or a prefix, a root and an ending that make one together."""
    begins = _edge(text, i)
    ends = _edge(text, j)
    if trie == "root":
        return ends or any(text.startswith(e, j) and _edge(text, j + len(e)) for e in ENDINGS)
    if trie == "prefix":
        return begins and (ends or any(text.startswith(r, j) for r in ROOTS))
    if trie == "ending":
        return not begins and ends
    if trie == "exponent":
        return True
    return begins and ends


@lru_cache(maxsize=8192)
def pieces(phrase: str, dimension: str = "probability") -> tuple[Piece, ...]:
    """The best cut of a phrase into pieces; what belongs to none is left out."""
    text, prior = phrase, PRIORS[dimension]
    n = len(text)
    best: list[tuple[float, tuple | None]] = [(0.0, None)] + [(-math.inf, None)] * n

    def offer(i: int, j: int, gain: float, piece: Piece | None) -> None:
        if best[i][0] + gain > best[j][0]:
            best[j] = (best[i][0] + gain, (i, piece))

    for i in range(n):
        offer(i, i + 1, -_LETTER_COST if text[i].isalnum() else -_MARK_COST, None)
        number = _NUMBER.match(text, i) if text[i].isdigit() and not text[i - 1 : i].isdigit() else None
        if number:
            offer(i, number.end(), _LETTER_GAIN * (number.end() - i) - _PIECE_COST, Piece("number", float(number[0]), i, number.end()))
        for name, node in _TRIES.items():
            j = i
            while j < n and (node := node.next.get(text[j])) is not None:
                j += 1
                for kind, value, of in node.readings:
                    if _fits(text, i, j, name):
                        offer(i, j, prior[of] - _PIECE_COST + _LETTER_GAIN * (j - i), Piece(kind, value, i, j))
    out, j = [], n
    while j:
        i, piece = best[j][1]
        if piece is not None:
            out.append(piece)
        j = i
    return tuple(reversed(out))


def _plain(phrase: str) -> str:
    text = re.sub(r"\s+", " ", phrase.strip().lower()).replace("−", "-")
    text = re.sub(r"\( ?1 ?- ?p ?\)", "(1-p)", text)
    return re.sub(r"\[ ?0 ?, ?([0-9.]+) ?\]", r"0-\1", text)


def segment(phrase: str, dimension: str = "probability") -> tuple[tuple[str, object], ...]:
    """(kind, value) of the pieces of a phrase, as read for a field of the dimension."""
    return tuple((p.kind, p.value) for p in pieces(_plain(phrase), dimension))


def unit_of_scale(scale: float | str) -> str:
    return scale if isinstance(scale, str) else _BY_SCALE.get(scale, f"per_{scale:.12g}")


def compose(cut: tuple[Piece, ...], in_cell: bool = False) -> list[Piece]:
    """Pieces with prefix, root, number and exponent put together as scales ('unit', with the scale as its value).

    'amount' is a number of hundredths or the like ("90 %"), which tells no unit of other values; 'divide' has its divisor.
    """
    out: list[Piece] = []
    k = 0

    def kind(at: int) -> str:
        return cut[at].kind if 0 <= at < len(cut) else ""

    def number(at: int) -> tuple[float, int] | None:
        """A number with its exponent, and the place behind it."""
        if kind(at) != "number":
            return None
        value, at = cut[at].value, at + 1
        if kind(at) == "raised":
            return value ** cut[at].value, at + 1
        if kind(at) == "power of":
            sign = -1 if kind(at + 1) == "range" else 1
            if kind(at + 1 + (sign < 0)) == "number":
                return value ** (sign * cut[at + 1 + (sign < 0)].value), at + 2 + (sign < 0)
        return value, at

    def take(what: str, value: object, behind: int) -> None:
        nonlocal k
        while kind(behind) == "ending" and cut[behind].start == cut[behind - 1].end:
            behind += 1
        out.append(Piece(what, value, cut[k].start, cut[behind - 1].end))
        k = behind

    while k < len(cut):
        p = cut[k]
        after = number(k + 1)
        if p.kind in ("ratio", "times") and after and after[0] > 0:
            take("unit", after[0], after[1])
        elif p.kind == "ratio" and kind(k + 1) == "root":
            take("unit", cut[k + 1].value, k + 2)
        elif p.kind == "power" and kind(k + 1) in ("unit", "field") and cut[k + 1].value in (1, "prob"):
            take("unit", 10.0 ** p.value, k + 2)
        elif p.kind in ("divide", "slash") and after and after[0] > 0:
            take("unit" if in_cell else "divide", after[0], after[1])
        elif p.kind == "root" and kind(k + 1) == "part of":
            take("unit", p.value, k + 2)
        elif p.kind == "uint" and after:
            take("unit", 2.0 ** after[0] - 1, after[1])
        elif p.kind == "number":
            value, behind = number(k)
            end = number(behind + 1) if kind(behind) == "range" else None
            bits = behind + (kind(behind) == "range")
            if value == 0 and end and end[0] > 0:
                take("unit", end[0], end[1])
            elif kind(bits) == "bits":
                take("unit", 2.0 ** value - 1, bits + 1)
            elif kind(behind) == "times" and kind(behind + 1) in ("field", "value"):
                take("unit", value, behind + 1)
            elif kind(behind) == "unit" and cut[behind].value in (100, 1000, 10_000):
                take("amount", None, behind + 1)
            elif kind(behind) == "ratio" and kind(behind + 1) == "root":
                take("amount", None, behind + 2)
            else:
                k = behind
        elif p.kind in ("unit", "field", "value", "all", "not", "keep", "part", "stop", "join", "of", "slash", "divide"):
            take(p.kind, p.value, k + 1)
        else:
            k += 1
    return out


def cell_unit(affix: str) -> str | None:
    """The unit shown by what stands around a number in a cell ("%", "/ 255", "Q", "p="), if any."""
    units = [p.value for p in compose(pieces(_plain(re.sub(r"\s+", "", affix))), in_cell=True) if p.kind == "unit"]
    return unit_of_scale(units[0]) if units else None


def _applies(text: str, unit: Piece, names_field: bool) -> bool:
    """Whether a unit is said of values, and not of something else ("percent of reads", "0-100 reads")."""
    behind = re.match(r"[\s)\]]*(of\s+(?:the\s+|all\s+)?)?([^\W\d_]+)?", text[unit.end :])
    if behind is None or behind[2] is None:
        return True
    known = WORDS.get(behind[2], ("", ""))[0]
    if behind[1]:
        return known in ("field", "value") or isinstance(unit.value, str)
    return names_field or bool(known) or behind[2] in ("at", "as", "in", "on", "for", "by", "from", "instead", "the", "range", "scale", "scaled", "units")


def note_units(note: str | None) -> dict[str, str]:
    """Unit of each field a free-text note speaks of; empty where it says nothing of scale.

    A statement is what a clause says of the fields it names, or of all where it names none. An amount ("kept 90 %"), and a
    unit of something other than values ("percent of reads"), is no statement.
    """
    if not note or not note.strip():
        return {}
    text = _plain(note)
    clauses: list[list[Piece]] = [[]]
    for piece in compose(pieces(text)):
        if piece.kind in ("part", "stop"):
            clauses.append([])
        else:
            clauses[-1].append(piece)
    said: dict[str, str] = {}
    for clause in clauses:
        kinds = {p.kind for p in clause}
        subjects = [str(p.value) for p in clause if p.kind == "field"]
        units = [unit_of_scale(p.value) for p in clause if p.kind == "unit" and _applies(text, p, bool(subjects))]
        divisors = [unit_of_scale(p.value) for p in clause if p.kind == "divide" and p.value]
        named = list(dict.fromkeys(f for v in subjects for f in _FIELDS[v]))
        precise = list(dict.fromkeys(f for v in subjects if v in OWN_UNIT and v != "prob" for f in _FIELDS[v]))
        if precise and "prob" not in named:
            named = precise
        elif "prob" in named and len(named) > 1 and not kinds & {"all", "join"}:
            # the subject of the clause is its first field ("prob column holds the raw ML byte")
            named = list(_FIELDS[subjects[0]])
        if "all" in kinds and ("prob" in named or not named):
            named = list(OWN_UNIT)
        if divisors:
            units = divisors[:1] if "not" in kinds else ["fraction"]
        elif "keep" in kinds and not units and named:
            said |= {f: OWN_UNIT[f] for f in named if f not in said}
            continue
        if not units:
            continue
        if not named:
            if len(units) > 1 and "slash" in kinds and units[0] != units[1]:
                said |= {"prob": units[0], "m5c_qual": units[1], "m6a_qual": units[1]}
                continue
            named = list(OWN_UNIT)
        said |= {f: units[0] for f in named if f not in said}
    return said


def to_fraction(value: float, unit: str) -> float:
    """A value of ``unit`` as a fraction in 0-1."""
    if unit == "phred":
        return 1.0 - 10.0 ** (-value / 10.0)
    if unit.startswith("per_"):
        return value / float(unit.removeprefix("per_"))
    return value / {"fraction": 1.0, "percent": 100.0, "permille": 1000.0, "byte": 255.0}[unit]
