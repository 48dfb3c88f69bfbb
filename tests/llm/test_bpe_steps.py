"""What a new word costs in encoding."""

import random

from lexmill.llm import bpe
from lexmill.llm.queries import vocabulary


def test_new_words_need_few_new_steps():
    """CPU: a step is built once for what may end at a place, whatever tokens stand before it."""
    codec, rng = bpe.Codec(bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))), random.Random(8)
    syllables = ["".join(rng.choices("aeioulnrst", k=3)) for _ in range(200)]
    words = ["".join(rng.choices(syllables, k=4)) for _ in range(4000)]
    for word in words:
        codec.encode(word)
    assert codec.pieces.transducer.moves < sum(map(len, words)) / 10
