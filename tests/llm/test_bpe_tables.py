"""The transducer's tables: bounded inside a piece, shared between pieces, and the splitting of Latin texts."""

import random

import pytest

from lexmill.llm import bpe
from lexmill.llm.queries import vocabulary


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))


def test_latin_texts_are_split_alike(ranks):
    codec, rng = bpe.Codec(ranks), random.Random(3)
    marks = ["'s", "'ll", " ", "  ", "\n", "\xa0", "\x85", "\x1c", "\xb2", "\xaa", "\xd7"]
    for _ in range(3000):
        text = "".join(rng.choices([*map(chr, range(256)), *marks * 8], k=rng.randint(0, 60)))
        assert codec.latin(text) == codec.any(text) == codec.split(text)
    assert codec.split("don’t stop") == codec.any("don’t stop")


def test_one_long_piece_stays_in_bounds(ranks):
    rng = random.Random(4)
    piece = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=20_000))
    free, bound = bpe.Codec(ranks), bpe.Codec(ranks)
    bound.pieces.transducer.max_bytes = 300_000
    assert free.encode(piece) == bound.encode(piece)
    small = bound.pieces.transducer
    assert small.STATE * len(small.sets) <= 300_000 < free.pieces.transducer.STATE * len(free.pieces.transducer.sets)


def test_pieces_met_again_outlive_a_full_table(ranks):
    """CPU: a new word costs the transducer, a known one a look-up, also when the table fills up."""
    codec, rng, asked = bpe.Codec(ranks), random.Random(5), []
    codec.pieces.max_bytes = 200_000
    encode = codec.pieces.transducer.encode_piece
    codec.pieces.transducer.encode_piece = lambda piece: (asked.append(piece), encode(piece))[1]
    for _ in range(2000):
        codec.encode("thontien " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12)))
    assert len(asked) > 1900 and asked.count(b"thontien") == 1
