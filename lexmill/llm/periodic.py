"""Runs of words that repeat with a period, from the Lyndon words of both orders.

A run is a maximal stretch with a smallest period q. Under one of the two orders of the words
(as they first appear, and the reverse), wherever the run's Lyndon root stands, that root is
the longest Lyndon word that begins there. So a stack scanned from right to left under both
orders names all candidates (start, period); each is extended to both sides by longest common
extensions. An extension compares a few words directly and then searches by bisection over
rolling hashes; a run counts only after its words were compared with those a period further.
No suffix array is built.

Defined results: a null or empty text has no words and no runs; repeated rows are judged each
for itself; texts may have any length (words are numbered slice by slice); an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexmill.llm.worker import no_collection

#: Words compared one by one before hashes are asked.
DIRECT = 12
_MODULUS = (1 << 61) - 1
_SPACES = b" \t\n\x0b\x0c\r"


class Extensions:
    """Longest common extensions of a sequence of numbers to the right and to the left."""

    def __init__(self, words: Sequence[int], base: int = 0x1F3D5B79A2C4E687):
        self.words, self.n, self.base = words, len(words), base % _MODULUS
        self.upto: list[int] = []
        self.power: list[int] = []

    def _hash(self) -> None:
        """Hashes of all beginnings, made when a text first needs them."""
        h, p, base = 0, 1, self.base
        self.upto, self.power = [0], [1]
        for w in self.words:
            h = (h * base + w + 1) % _MODULUS
            p = p * base % _MODULUS
            self.upto.append(h)
            self.power.append(p)

    def _longest(self, i: int, j: int, most: int, step: int) -> int:
        """The longest common extension of at most ``most`` words: all of them, or doubling, then bisection."""
        if not self.upto:
            self._hash()
        upto, power = self.upto, self.power

        def same(k: int) -> bool:
            a, b = (i, j) if step > 0 else (i - k + 1, j - k + 1)
            return (upto[a + k] - upto[a] * power[k] - upto[b + k] + upto[b] * power[k]) % _MODULUS == 0

        good, bad = 0, 2 * DIRECT
        if bad <= most and same(bad):  # inside a long run the rest is often equal
            if same(most):
                return most
            while bad <= most and same(bad):
                good, bad = bad, bad * 2
        bad = min(bad, most + 1)
        while bad - good > 1:
            k = (good + bad) // 2
            good, bad = (k, bad) if same(k) else (good, k)
        return good

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        words, most = self.words, self.n - j
        for k in range(min(DIRECT, most)):
            if words[i + k] != words[j + k]:
                return k
        return most if most <= DIRECT else self._longest(i, j, most, 1)

    def left(self, i: int, j: int) -> int:
        """How many words up to and with i equal those up to j; i < j."""
        words, most = self.words, i + 1
        for k in range(min(DIRECT, most)):
            if words[i - k] != words[j - k]:
                return k
        return most if most <= DIRECT else self._longest(i, j, most, -1)


def lyndon_ends(words: Sequence[int], extensions: Extensions, sign: int) -> Sequence[int]:
    """Where the longest Lyndon word from each place ends: the next smaller suffix. ``sign`` -1 takes the reverse order; an end is smaller than any word."""
    n = len(words)
    ends = [n] * n if n < 1 << 20 else array("i", [n]) * n
    right = extensions.right
    for i in range(n - 2, -1, -1):
        x, j = words[i], i + 1
        while j < n:
            ahead = (words[j] - x) * sign
            if ahead == 0:
                k = right(i, j)
                ahead = -1 if j + k == n else (words[j + k] - words[i + k]) * sign
            if ahead < 0:
                break
            j = ends[j]
        ends[i] = j
    return ends


def runs(words: Sequence[int], least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of at least ``least`` words and ``exponent`` (2 or more) periods, by start and period."""
    n = len(words)
    if n < max(least, exponent):
        return []
    for base in (0x1F3D5B79A2C4E687, 0x0B7E151628AED2A7, 0x243F6A8885A308D3):
        extensions = Extensions(words, base)
        found = _candidates_extended(words, extensions, least, exponent)
        if all(_verified(words, run) for run in found):
            return sorted(found, key=lambda r: (r[0], r[2]))
    raise ArithmeticError("hashes disagree with words")


def _candidates_extended(words, extensions: Extensions, least: int, exponent: int) -> set[tuple[int, int, int]]:
    flat, n = np.asarray(words, np.int64), len(words)
    here = np.arange(n, dtype=np.int64)
    found: set[tuple[int, int, int]] = set()
    for sign in (1, -1):
        period = np.asarray(lyndon_ends(words, extensions, sign), np.int64) - here
        # From the run's first root on there are more than exponent - 1 periods: as many equal words, a period apart.
        at = np.flatnonzero(here + (exponent - 1) * period < n)
        for times in range(exponent - 1, 0, -1):
            at = at[flat[at] == flat[at + times * period[at]]]
        covered: dict[int, int] = {}  # by period, where its last run ends
        for i, p in zip(at.tolist(), period[at].tolist(), strict=True):
            if covered.get(p, 0) >= i + p:
                continue
            ahead, back = extensions.right(i, i + p), extensions.left(i - 1, i + p - 1) if i else 0
            start, length = i - back, back + ahead + p
            covered[p] = start + length
            if length >= max(least, exponent * p):
                found.add((start, length, p))
    return found


def _verified(words, run: tuple[int, int, int], slice_: int = 1 << 16) -> bool:
    """Word by word: the period holds throughout and in no neighbouring word."""
    start, length, p = run
    end = start + length
    for a in range(start, end - p, slice_):
        b = min(a + slice_, end - p)
        if words[a:b] != words[a + p : b + p]:
            return False
    return (start == 0 or words[start - 1] != words[start - 1 + p]) and (end == len(words) or words[end] != words[end - p])


def numbered_words(text: bytes, slice_: int = 1 << 20) -> tuple[Sequence[int], list[bytes]]:
    """A text's words as numbers in the order of first appearance, and the words."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    if len(text) <= slice_:
        out: Sequence[int] = list(map(number.__getitem__, text.split()))
    else:
        out, at = array("i"), 0
        while at < len(text):
            end = at + slice_
            while end < len(text) and text[end] not in _SPACES:
                end += 1
            out.extend(map(number.__getitem__, text[at:end].split()))
            at = end
    return out, list(number)


def collapsed(numbers: Sequence[int], known: list[bytes], found: list[tuple[int, int, int]], slice_: int = 1 << 17) -> bytes:
    """The words joined by spaces, without those that a run contains after its first period."""
    if found:
        drop = np.zeros(len(numbers) + 1, np.int32)
        for start, length, p in found:
            drop[start + p] += 1
            drop[start + length] -= 1
        numbers = np.asarray(numbers)[np.cumsum(drop[:-1]) == 0].tolist()
    return b" ".join(b" ".join(map(known.__getitem__, numbers[a : a + slice_])) for a in range(0, len(numbers), slice_))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """``(id, n_words, runs ARRAY<STRUCT<start, length, period>>, collapsed)`` of each row; runs by start, then period."""
    run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                n, lists, texts = [], [], []
                with no_collection():
                    for value in batch.column(1).cast(pa.binary()):
                        numbers, known = numbered_words(value.as_py() or b"")
                        found = runs(numbers, least, exponent)
                        n.append(len(numbers))
                        lists.append([dict(zip(("start", "length", "period"), run, strict=True)) for run in found])
                        texts.append(collapsed(numbers, known, found))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lists, pa.list_(run_type)), pa.array(texts, pa.binary()).view(pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(judged, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)
