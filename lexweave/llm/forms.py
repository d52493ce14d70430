"""Plain form and words of a text, as Column expressions (JVM side, no Python worker).

``same_form`` brings texts that look the same to one sequence of characters: full-width and
ligature forms, combining accents, invisible characters, special blanks and hyphens and
Cyrillic or Greek look-alike letters become their plain counterparts. Nothing else changes:
case, ordinary blanks, punctuation, ``0``/``O``, ``1``/``l`` and ``a``/``ä`` stay apart.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters without a glyph of their own.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︎️﻿"
# Blanks other than the ordinary one, the tab and the line breaks.
BLANKS = "               　"
# Hyphens that look like the ASCII one (dashes are punctuation of their own).
HYPHENS = "‐‑⁃﹣"
# Cyrillic and Greek letters and the Latin letters they look like.
LOOKALIKES = {
    "АВЕЅІЈКМНОРСТУХҮԌԚԜ": "ABESIJKMHOPCTYXYGQW",
    "асеорхуіјѕһԁԛԝҽӏ": "aceopxyijshdqwel",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ": "ABEZHIKMNOPTYXCM",
    "ονϲϳιαρυ": "ovcjiapu",
}
# Ligatures and the letters they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ŉ": "'n", "ǆ": "dž", "ǉ": "lj", "ǌ": "nj", "ǳ": "dz"}

WORD = r"[\p{L}\p{N}]+"
#: A text of characters that ``same_form`` never changes, in few ranges that hold the letters and signs of usual texts.
USUAL = r"^[\x00-\x9f\xa1-\xac\xae-\u0131\u014a-\u017f\u2012-\u2026]*+\z"


@cache
def fold_table() -> tuple[str, str]:
    """``(matching, replace)`` for ``translate``; characters past the end of ``replace`` vanish."""
    pairs = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= dict.fromkeys(BLANKS, " ") | dict.fromkeys(HYPHENS, "-")
    for odd, plain in LOOKALIKES.items():
        pairs |= dict(zip(odd, plain, strict=True))
    return "".join(pairs) + INVISIBLE, "".join(pairs.values())


@cache
def compositions() -> tuple[tuple[str, str], ...]:
    """Letter and combining mark pairs with the letter they compose to, shortest first."""
    found = []
    for c in (*range(0xC0, 0x250), *range(0x374, 0x500), *range(0x1E00, 0x1F00)):
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", chr(c)) == chr(c):
            found.append(("".join(chr(int(x, 16)) for x in parts.split()), chr(c)))
    return tuple(sorted(found, key=lambda p: len(unicodedata.normalize("NFD", p[1]))))


def fold_lookalikes(text: Column) -> Column:
    """``text`` with every single-character variant replaced; accents stay as they are."""
    folded = F.translate(text, *fold_table())
    if LIGATURES:
        whole = folded
        for a, b in LIGATURES.items():
            whole = F.replace(whole, F.lit(a), F.lit(b))
        folded = F.when(folded.rlike("[" + "".join(LIGATURES) + "]"), whole).otherwise(folded)
    return folded


def compose(text: Column) -> Column:
    """``text`` with letters and combining marks brought together; only texts that hold a mark pay for it."""
    # One literal, which the optimizer folds, in place of hundreds of expressions.
    pairs = json.dumps([{"parts": a, "one": b} for a, b in compositions()])
    table = F.from_json(F.lit(pairs), "array<struct<parts:string,one:string>>")
    whole = F.aggregate(table, text, lambda t, p: F.replace(t, p["parts"], p["one"]))
    return F.when(text.rlike("[̀-ͯ]"), whole).otherwise(text)


@cache
def odd_class() -> str:
    """Regular expression for any character that ``same_form`` may change, in few ranges; it fails at once on ASCII."""
    marks = "".join(map(chr, range(0x300, 0x370)))
    codes = sorted({ord(c) for c in fold_table()[0] + "".join(LIGATURES) + marks})
    spans: list[list[int]] = []
    for c in codes:
        if spans and c - spans[-1][1] <= 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    wide = [[0x370, 0x52F], *(x for x in spans if not 0x370 <= x[0] <= 0x52F)]
    return "(?=[^\\x00-\\x9f])[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in wide) + "]"


def odd(text: Column) -> Column:
    """Whether ``text`` holds a character that ``same_form`` may change; most texts are ASCII or of usual characters and need no search."""
    return (F.length(text) != F.octet_length(text)) & ~text.rlike(USUAL) & text.rlike(odd_class())


def same_form(text: Column) -> Column:
    """The plain form in which texts that look the same are equal; null stays null.

    Few texts hold a character to change, so one search keeps the others from the slow replacements.
    """
    # Bound to a name, so that the folded text is made once and not for each mention in ``compose``.
    changed = F.transform(F.array(fold_lookalikes(text)), compose)[0]
    return F.when(odd(text), changed).otherwise(text)


def words(text: Column) -> Column:
    """Runs of letters and digits of the same form in lower case; ``[]`` for a blank text, null for null."""
    return F.regexp_extract_all(F.lower(same_form(text)), F.lit(WORD), F.lit(0))
