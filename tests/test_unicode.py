"""Normal forms as columns against the standard library, character by character and on drawn texts."""

import random
import sys
import unicodedata

import pytest
import regex
from pyspark.sql import functions as F

from lexmill.functions import unicode
from lexmill.functions.text import ARTICLES
from lexmill.operators import metrics

ASSIGNED = [chr(i) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) not in ("Cn", "Cs", "Co")]


def words(text):
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return [w for w in regex.findall(r"[\p{L}\p{N}_]+", bare) if w not in ARTICLES]


def drawn(n, seed=5):
    r = random.Random(seed)
    odd = [c for c in ASSIGNED if unicodedata.combining(c) or unicodedata.decomposition(c) or 0x1100 <= ord(c) < 0x1200 or 0xAC00 <= ord(c) < 0xAC40]
    return ["".join(r.choice(odd) if r.random() < 0.5 else r.choice("aeionAEZ le'-\n") for _ in range(r.randint(0, 24))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)


@pytest.fixture(scope="module")
def singles(spark):
    """Every assigned character between two letters; those unknown to the JVM are told apart."""
    texts = [f"x{c}y" for c in ASSIGNED]
    known = {r.i for r in frame(spark, ASSIGNED).where(~F.col("t").rlike(r"^\p{Cn}")).select("i").collect()}
    assert len(known) > 0.9 * len(ASSIGNED)
    return texts, known


def test_words_of_every_character(spark, singles):
    texts, known = singles
    got = {r.i: r.w for r in frame(spark, texts).select("i", metrics.answer_tokens(F.col("t")).alias("w")).collect()}
    assert [(hex(ord(ASSIGNED[i])), got[i], words(t)) for i, t in enumerate(texts) if i in known and got[i] != words(t)] == []


def test_composition_of_every_character(spark, singles):
    texts, _ = singles
    rows = frame(spark, texts).select("i", unicode.composed(F.col("t")).alias("c"), unicode.maybe_decomposed(F.col("t")).alias("m")).collect()
    assert [hex(ord(ASSIGNED[r.i])) for r in rows if r.c != unicodedata.normalize("NFC", texts[r.i])] == []
    assert [r.i for r in rows if not r.m and not unicodedata.is_normalized("NFC", texts[r.i])] == []


def test_drawn_texts(spark, singles):
    _, known = singles
    unknown = {c for i, c in enumerate(ASSIGNED) if i not in known}
    texts = [t for t in drawn(3000) if not unknown & set(t)] + ["", "été", "été", "한국어 각", "한", "ạ̇", "ạ̇", "ΟΔΟΣ ΟΔΟΣ.", "İstanbul", "L'Été d'une"]
    rows = frame(spark, texts).select("i", unicode.composed(F.col("t")).alias("c"), metrics.answer_tokens(F.col("t")).alias("w")).collect()
    assert len(rows) == len(texts) > 2000
    assert [texts[r.i] for r in rows if r.c != unicodedata.normalize("NFC", texts[r.i])] == []
    assert [(texts[r.i], r.w, words(texts[r.i])) for r in rows if r.w != words(texts[r.i])] == []


def test_null_and_long(spark):
    long = "déjà " * 50_000
    rows = spark.createDataFrame([(0, None), (1, long), (2, "z" * 300_000)], "i long, t string").select("i", unicode.composed(F.col("t")).alias("c"), metrics.answer_tokens(F.col("t")).alias("w"))
    got = {r.i: (r.c, r.w) for r in rows.collect()}
    assert got[0] == (None, None) and got[1] == ("déjà " * 50_000, ["deja"] * 50_000) and got[2] == ("z" * 300_000, ["z" * 300_000])


def test_words_need_no_python(spark):
    plan = frame(spark, ["a"]).select(metrics.answer_tokens(F.col("t")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_composed_texts_stay_in_the_jvm(spark):
    texts = ["Un œuf — l’été", "中文 text", "Привет", "日本語"]
    assert [r[0] for r in frame(spark, texts).select(unicode.maybe_decomposed(F.col("t"))).collect()] == [False] * 4
