"""Queries without SQL twins, drawn or learned again in plain Python."""

import hashlib
import json
import os
import unicodedata
from collections import Counter

import pytest
import regex

from lexmill.functions import text as tx
from lexmill.operators import synthetic, tokens
from lexmill.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def uniform(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16) / 2**32


def test_pre_tokens(spark):
    find = regex.compile(tx.PRE_TOKEN).findall
    want = Counter()
    for r in catalog.docs(spark, DATA).select("text").collect():
        want.update(find(unicodedata.normalize("NFC", (r.text or "").replace("<|", "< |"))))
    got = {r.word: r.n for r in catalog.QUERIES["pre_tokens"](spark, DATA).collect()}
    assert got == {w: n for w, n in want.items() if n >= 2}


def test_sampled_tokens(spark):
    import math

    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = {r.step: r.token_id for r in catalog.QUERIES["sampled_tokens"](spark, DATA).collect()}
    assert set(got) == {r.vec_id for r in rows}
    for r in rows:
        e = [math.exp((x - max(r.embedding)) * 10 / 0.7) for x in r.embedding]
        at, total = uniform(11, r.vec_id) * sum(e), 0.0
        for i, x in enumerate(e):
            total += x
            if total >= at - 1e-9:
                break
        assert got[r.vec_id] == i or abs(total - at) < 1e-6


def test_two_turn_mix(spark):
    one = [[r.question, r.answer] for r in synthetic.arithmetic(spark, 1200, 3).orderBy("i").collect()]
    got = {r.k: [m["content"] for m in json.loads(r.messages)] for r in catalog.QUERIES["two_turn_mix"](spark, DATA).collect()}
    assert set(got) == set(range(180))
    for k, contents in got.items():
        a, b = int(uniform(3, "first", k) * 1200), int(uniform(3, "second", k) * 1199)
        assert contents == one[a] + one[b + (b >= a)]


def test_picked_groups(spark):
    got = {(r.name, r.k): (r.question, r.answer) for r in catalog.QUERIES["picked_groups"](spark, DATA).collect()}
    want = {}
    for name, questions, answers in catalog.GROUPS:
        for k in range(1, 9):
            want[name, k] = questions[int(uniform(3, "questions", name, k) * len(questions))], answers[int(uniform(3, "answers", name, k) * len(answers))]
    assert got == want


def test_sums_are_right(spark):
    rows = synthetic.arithmetic(spark, 3000, 8).collect()
    for r in rows:
        numbers = [int(x) for x in regex.findall(r"\d+", r.answer)]
        a, b, value = numbers
        assert {"+": a + b, "-": a - b, "*": a * b}[r.op] == value and value >= 0 and (" fait " in r.answer) <= (value == 1)
        assert a <= {"+": 50, "-": 60, "*": 10}[r.op]
    assert {max(r.a for r in rows if r.op == op) for op in "+-*"} == {50, 60, 10}
    assert 0.4 < sum(r.op == "+" for r in rows) / len(rows) < 0.6 and 0.55 < sum("=" not in r.answer for r in rows) / len(rows) < 0.65


def test_assembly_is_the_same_each_time_and_alternates(spark):
    build = lambda seed: [(r.pos, r.family, tuple((m.role, m.content) for m in r.messages)) for r in synthetic.assembled(catalog.families(spark, DATA, seed), seed).orderBy("pos").collect()]
    first, again, other = build(3), build(3), build(4)
    assert first == again and first != other and len(first) > 1500
    assert [p for p, _, _ in first] == list(range(len(first)))
    assert all([role for role, _ in m] == ["user", "assistant"] * (len(m) // 2) for _, _, m in first)


def test_epoch_gives_each_rank_the_same_number_of_batches(spark):
    rows = spark.createDataFrame([(i, i * 37 % 101) for i in range(103)], "ord long, n int")
    seen = []
    for rank in range(2):
        got = tokens.bucketed_batches(rows, 6, 5, 1, multiple=3, rank=rank, world=2).collect()
        assert len(got) == 103 // 2 // 6 * 6 and sorted({r.place for r in got}) == list(range(8))
        assert all(c == 6 for c in Counter(r.place for r in got).values())
        seen += [r.ord for r in got]
    assert len(seen) == len(set(seen))
