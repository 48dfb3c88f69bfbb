"""Canonical normal forms as columns, from rules over the standard library's character data.

Spark has no built-in for them. Words for comparison need no order of marks, since marks are
dropped: a translation of single characters does. Composition is asked of Python only for texts
that a native test doesn't find composed already.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The arithmetic of Hangul syllables.
SYLLABLE, LEAD, VOWEL, TRAIL, VOWELS, TRAILS = 0xAC00, 0x1100, 0x1161, 0x11A7, 21, 28


def _characters() -> Iterator[str]:
    return (chr(i) for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000 and not SYLLABLE <= i < SYLLABLE + 11172)


@functools.cache
def _marks_off() -> tuple[str, str, str]:
    """Characters and what stands for each once decomposed and without marks (those at the end: nothing); letters that a break follows."""
    changed, to, gone, broken = [], [], [], []
    for c in _characters():
        rest = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if not rest:
            gone.append(c)
        elif rest != c:
            # Of several, only the first can be a letter; spacing marks divide words.
            letter = unicodedata.category(rest[0])[0] in "LN"
            changed.append(c)
            to.append(rest[0] if letter or len(rest) == 1 else " ")
            if letter and len(rest) > 1:
                broken.append(c)
    return "".join(changed + gone), "".join(to), "".join(broken)


def _jamo(c: Column) -> Column:
    """Hangul syllables as their letters."""

    def letters(first: int, at: Column, n: int) -> Column:
        return F.element_at(F.array(*[F.lit(chr(first + i)) for i in range(n)]), at.cast("int") + 1)

    def one(x: Column) -> Column:
        i = F.ascii(x) - SYLLABLE
        trail = F.when(i % TRAILS == 0, F.lit("")).otherwise(letters(TRAIL, i % TRAILS, TRAILS))
        parts = F.concat(letters(LEAD, F.floor(i / (VOWELS * TRAILS)), 19), letters(VOWEL, F.floor(i % (VOWELS * TRAILS) / TRAILS), VOWELS), trail)
        return F.when((i >= 0) & (i < 11172), parts).otherwise(x)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def unmarked(c: Column) -> Column:
    """Canonically decomposed and without nonspacing marks; spacing marks that belong to a character become blanks."""
    source, target, broken = _marks_off()
    spelled = F.when(c.rlike("[가-힣]"), _jamo(c)).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(F.regexp_replace(spelled, f"([{broken}])", "$1 "), source, target)).otherwise(c)


def _ranges(codes: Iterable[int], gap: int = 4) -> str:
    """A character class of the codes, and of few others between them."""
    cut: list[list[int]] = []
    for i in sorted(codes):
        if cut and i - cut[-1][1] <= gap:
            cut[-1][1] = i
        else:
            cut.append([i, i])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in cut) + "]"


@functools.cache
def _suspects() -> str:
    """What may change by composition: characters that never stay, that have a place in an order of marks, or that join the one before."""
    found = set(range(VOWEL, VOWEL + VOWELS)) | set(range(TRAIL + 1, TRAIL + TRAILS))
    for c in _characters():
        if unicodedata.combining(c) or unicodedata.normalize("NFC", c) != c:
            found.add(ord(c))
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(int(parts[0], 16)) + chr(int(parts[1], 16))) == c:
            found.add(int(parts[1], 16))
    return _ranges(found)


def maybe_decomposed(c: Column) -> Column:
    """False only for texts that are in composed form already; Latin letters, quotes and dashes are passed over at once."""
    return c.rlike(r"[^\x00-\x{2ff}\x{2010}-\x{2027}\x{20a0}-\x{20bf}]") & c.rlike(_suspects())


@F.pandas_udf(T.StringType())
def _composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield t.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def composed(c: Column) -> Column:
    """Canonical composition (NFC). Texts that a native test finds composed don't go to Python."""
    doubtful = maybe_decomposed(c)
    return F.when(doubtful, _composed(F.when(doubtful, c))).otherwise(c)
