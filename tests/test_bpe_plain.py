"""Latin texts are cut in Python as the JVM cuts them; counts and ids are those of the native cut."""

import random
import re

from pyspark.sql import functions as F

from lexmill.functions.text import LATIN_PRE_TOKEN, is_latin, pre_tokens
from lexmill.operators import bpe_training


def test_latin_texts_are_cut_alike(spark):
    rng = random.Random(6)
    letters = list(map(chr, range(0x100)))
    marks = ["'s", "'S", "'Re", "'vE", "'lL", "'d", " ", "  ", "\r\n", "\n", "a", "1", "\xa0", "\x85", "\x1c", "é"]
    texts = ["".join(rng.choices([*letters, *marks * 20], k=rng.randint(0, 80))) for _ in range(3000)] + letters
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", is_latin(F.col("t")).alias("latin"), pre_tokens(F.col("t")).alias("w")).collect()
    cut = re.compile(LATIN_PRE_TOKEN).findall
    assert all(r.latin and cut(texts[r.i]) == r.w for r in rows)


def test_latin_and_other_texts(spark):
    rows = spark.createDataFrame(list(enumerate(["Un mot, un mot’s", "日本 mot", "e\u0301te\u0301 été", "<|x", "", None])), "i long, t string")
    counts = {r.word: r.n for r in bpe_training.word_frequencies(rows, "t", 1).collect()}
    assert counts == {"Un": 1, ",": 1, " un": 1, "’s": 1, "日本": 1, "été": 1, " été": 1, "<": 1, " ": 1, "|x": 1, " mot": 3}
    own = bpe_training.Tokenizer([(b"m", b"o"), (b"mo", b"t")])
    native = {r.i: r.ids for r in rows.select("i", own.encode_col(F.col("t")).alias("ids")).collect()}
    assert {r.i: r.ids for r in own.encode(rows, "t").collect()} == native and native[4] == native[5] == []
