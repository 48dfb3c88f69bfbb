"""What a worker's tables for encoding take when texts keep bringing new words; small and full tables give the same."""

import random
import subprocess
import sys

from lexmill.llm import bpe
from lexmill.llm.queries import vocabulary

MEASURED = """
import random
from lexmill.llm import bpe
from lexmill.llm.queries import vocabulary

held = lambda: next(int(x.split()[1]) for x in open("/proc/self/status") if x.startswith("RssAnon")) // 1024
codec, rng = bpe.Codec(bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken"))), random.Random(7)
syllables = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz\\u00e9\\u00fc", k=3)) for _ in range(3000)]
before = held()
for _ in range(1500):
    codec.encode(" ".join("".join(rng.choices(syllables, k=4)) for _ in range(100)))
print(held() - before)
"""


def test_tables_of_new_words_stay_small():
    """Memory: 150,000 words that no text had before."""
    took = int(subprocess.run([sys.executable, "-c", MEASURED], capture_output=True, text=True, check=True, timeout=300).stdout)
    assert took < 140, took


def test_pieces_are_encoded_alike_in_any_order_and_with_small_tables():
    ranks, rng = bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), random.Random(9)
    words = ["".join(rng.choices("aentsé", k=rng.randint(1, 12))).encode() for _ in range(2000)] + [b"ab" * 3000, b"ab" * 2000, b"ab" * 2001]
    free, small = bpe.Transducer(ranks), bpe.Transducer(ranks, 20_000)
    got = {w: free.encode_piece(w) for w in sorted(words)}
    assert [small.encode_piece(w) for w in words] == [got[w] for w in words]
    assert all(b"".join(map(free.bytes_of.__getitem__, ids)) == w for w, ids in got.items())


def test_long_and_new_pieces_of_many_texts_at_once():
    ranks, rng = bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), random.Random(10)
    texts = ["", "x" * 100, "thon tien " + "y" * 70 + " thon", "", *["".join(rng.choices("abc é\u4e00😀", k=300)) for _ in range(200)], "x" * 100, ""]
    one, many = bpe.Codec(ranks), bpe.Codec(ranks)
    many.pieces.max_bytes = 20_000
    for part in (texts, texts[:3], [], texts[::-1]):
        ids, begins = many.encode_all(part)
        want = [one.encode(t) for t in part]
        assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == want
        assert [bytes(x).decode() for x in many.listed(ids, begins)] == [",".join(map(str, x)) for x in want]
        assert list(many.decode_all(ids, begins)) == part
