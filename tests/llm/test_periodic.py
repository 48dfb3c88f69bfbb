"""Runs against trying every period at every place; the query against the same, with planted repetitions."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from lexmill.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, exponent=4):
    """Each period's stretches of equal words a period apart, unless a smaller one holds in them."""
    n, found = len(words), []
    for p in range(1, n // exponent + 1):
        same = [words[i] == words[i + p] for i in range(n - p)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            length = j - i + p
            if j > i and length >= max(least, exponent * p) and not any(all(words[k] == words[k + q] for k in range(i, i + length - q)) for q in range(1, p)):
                found.append((i, length, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def left_without(words, found):
    gone = {k for s, n, p in found for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (1, 3), (9, 2)])
def test_runs_of_small_words(least, exponent):
    rng = random.Random(least)
    for _ in range(1500):
        n = rng.randint(0, 45)
        words = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(n)]
        if n and rng.random() < 0.6:
            a, p = rng.randrange(n), rng.randint(1, 9)
            words = [words[i] if i < a or a + (i - a) % p >= n else words[a + (i - a) % p] for i in range(n)]
        assert periodic.runs(words, least, exponent) == brute(words, least, exponent)


def test_long_repetitions_take_extensions_by_hash():
    rng = random.Random(4)
    for p in (1, 13, 40, 97):
        root = [rng.randrange(50) for _ in range(p)]
        words = [99] + root * 5 + root[: p // 2] + [98] + root * 6 + [97, 96]
        assert periodic.runs(words) == brute(words)
    thue = [bin(i).count("1") % 2 for i in range(3000)]  # no three repetitions
    assert periodic.runs(thue, 3, 3) == [] and periodic.runs(thue[:500], 2, 2) == brute(thue[:500], 2, 2)
    assert periodic.runs([0] * 200_000) == [(0, 200_000, 1)]


def test_rows(spark):
    texts = ["a b " * 9 + "c", "", None, "x", "  \t", "no run in this text at all", "la " * 300_000, "la " * 6, "la " * 5, "é ü " * 12 + "ü é " * 12, "x y z " * 8]
    rows = [(i, t, "own", 7) for i, t in enumerate(texts)] + [(0, texts[0], "own", 7), (None, texts[0], None, None)]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, start int"))
    have = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()), key=repr)
    expected = []
    for i, t, *_ in rows:
        words = WORD.findall(t or "")
        found = brute(words) if len(words) < 1000 else [(0, 300_000, 1)]
        expected.append((i is None, i or 0, len(words), found, left_without(words, found)))
    assert have == sorted(expected, key=repr)
    assert periodic.periodic_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_slices_number_words_alike():
    text = " ".join(f"w{i % 37}" for i in range(5000)).encode()
    for size in (7, 100, 1 << 20):
        numbers, known = periodic.numbered_words(text, size)
        assert [known[i] for i in numbers] == text.split()


def test_query(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(30)}" for _ in range(rng.choice([0, 1, 4, 30, 200])))) for i in range(200)] + [(None, "a " * 8), (900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    for r in queries.op12_lyndon_runs(spark, str(tmp_path)).collect():
        words = WORD.findall(dict(rows)[r.doc_id] or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        found = brute(words)
        best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3) and r.n_runs == len(found)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(left_without(words, found).encode()).hexdigest()
    assert planted > 10
