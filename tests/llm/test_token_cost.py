"""Token files: what coding and new words cost, and texts taken many at a time against the library."""

import time

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lexmill.llm import tokenfile
from lexmill.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def test_coding_costs_little():
    rng = np.random.default_rng(3)
    blocks = [np.minimum(rng.zipf(1.2, 2048), 49_000) for _ in range(1000)]
    some = rng.integers(0, 1 << 62, 2048 * 1000)

    def seconds(run):
        def once():
            start = time.process_time()
            run()
            return time.process_time() - start

        return min(once() for _ in range(3))

    # The measure is how long the same number of keys take to argsort, so that the machine's speed drops out.
    measure = seconds(lambda: np.argsort(some, kind="stable"))
    coded = tokenfile.encode_blocks(blocks)
    took = seconds(lambda: tokenfile.decode_blocks([(2048, c) for c in coded])) + seconds(lambda: tokenfile.encode_blocks(blocks))
    assert took < 9 * measure, took / measure


class Counting:
    """A tokenizer's model that counts what it is asked."""

    def __init__(self, model):
        self.model, self.asked = model, []

    def tokenize(self, word):
        self.asked.append(word)
        return self.model.tokenize(word)


def test_a_piece_is_asked_for_once():
    words = tokenfile.Words(Tokenizer.from_file(PATH))
    words.model = Counting(words.model)
    text = "Thoraten thoraten, (thoraten) THORATEN! thoraten-x2 Élan élan. ÉLAN"
    assert np.frombuffer(words.text(text.encode()), "<u2").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert sorted(words.model.asked) == sorted({"thoraten", "x", "élan".encode().decode("latin-1").replace("\xa9", "©")})


TEXTS = [
    "", None, " ", "\n\n", "a", "A", "É", "éÀßÿ ŸÞ", "3×4÷2", "x×y ×", "don't L'ÉTÉ 'tis it's", "<|endoftext|>x <|startoftext|>", "a<b>c <", "é É é́x",
    "名前abc x名 ,名,", "a b c\x1cd\x85e", "42 4two2 ½ ²", "#$%a!!b...", "\x00\x01\x7f", "İstanbul ΣΑΣ ǅ", "😀 a😀", "ab­c «x» “y”", "Ç", "ç", "-", "Nº ªÉ µM", "end",
]


@pytest.mark.parametrize("near", [8, 1 << 17])
def test_many_texts_are_the_library(monkeypatch, near):
    monkeypatch.setattr(tokenfile, "_NEAR", near)
    tokenizer = Tokenizer.from_file(PATH)
    texts = [*TEXTS, *TEXTS[::-1], " ".join(t or "" for t in TEXTS) * 5, "x" * 300 + " " + "É" * 300, "long " * 200]
    array = pa.array(["before", *texts], pa.string()).cast(pa.binary()).slice(1)
    ids, at = tokenfile.Words(tokenizer).texts(array, b"\1\0")
    ids = np.frombuffer(ids, "<u2").tolist()
    for text, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True):
        assert ids[a:b] == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], text
    assert at[0] == 0 and at[-1] == len(ids)


def test_damaged_characters_stay_in_their_text():
    texts = [b"ab\xc3", b"\xa9cd", b"\xc3\xc3\xa9", b"\xa9", b"x\xe2\x80 y", b"\xc3 \xa9", b"ok"]
    tokenizer = Tokenizer.from_file(PATH)
    ids, at = tokenfile.Words(tokenizer).texts(pa.array(texts, pa.binary()), b"\1\0")
    for text, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True):
        assert np.frombuffer(ids, "<u2").tolist()[a:b] == [*tokenizer.encode(text.decode(errors="replace"), add_special_tokens=False).ids, 1], text


@pytest.mark.parametrize("length", [1, 31, 33, 1500, 2048, 2600, 5000])
def test_blocks_of_any_length(length):
    rng = np.random.default_rng(length)
    blocks = [np.minimum(rng.zipf(1.1, max(0, length - 7 * i)), 65_535) for i in range(70)] + [np.full(length, 65_535), np.zeros(length, np.int64), np.arange(length) % 3]
    coded = tokenfile.encode_blocks(blocks)
    back = tokenfile.decode_blocks([(len(b), c) for b, c in zip(blocks, coded, strict=True)])
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
