"""Token files: the coder's round trip, the library's ids, damage, places of documents over blocks and files."""

import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexmill.llm import queries, tokenfile
from lexmill.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 65535), st.integers(0, 3)), max_size=400), max_size=6))
def test_round_trip_of_any_ids(blocks):
    blocks = [np.array(b, np.int64) for b in blocks]
    coded = tokenfile.encode_blocks(blocks, lanes=4)
    back = tokenfile.decode_blocks([(len(b), c) for b, c in zip(blocks, coded, strict=True)], lanes=3)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    assert coded == [tokenfile.encode_blocks([b])[0] for b in blocks]  # blocks don't see each other


def test_predictions_shorten_the_code():
    rng = np.random.default_rng(1)
    size = lambda b: len(tokenfile.encode_blocks([np.asarray(b)])[0])
    random_ids = rng.integers(0, 65536, 2048)
    skewed = np.minimum(rng.zipf(1.4, 2048), 65535)
    repeated = np.tile(rng.integers(0, 65536, 64), 32)
    assert size(random_ids) < 2048 * 2.4 and size(skewed) < 0.55 * 2 * 2048 and size(repeated) < 600
    worst = np.concatenate([np.tile([1, 2], 500), rng.integers(0, 65536, 1048)])  # carries, and what was expected fails
    assert (tokenfile.decode_blocks([(len(worst), tokenfile.encode_blocks([worst])[0])])[0] == worst).all()


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\x0b\x0c\r.,'!?<|>aAbBéÉ̀ſßΣ漢09\x85\xa0　\x1c"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_words_are_the_library(text):
    tokenizer = Tokenizer.from_file(PATH)
    got = np.frombuffer(tokenfile.Words(tokenizer).text(text.encode()), "<u2").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def rows():
    rng = random.Random(6)
    known = ["the", "House,", "l'été", "don't", "42", "<|endoftext|>", "naïve!", "漢字", '"quoted"', "x" * 90]
    return [(i * 3, " ".join(rng.choices(known, k=rng.choice([0, 1, 20, 400, 9000])))) for i in range(60)] + [(1, None), (None, "no id"), (3, "the same id again"), (6, "twice"), (6, "twice")]


@pytest.mark.parametrize("block", [50, 2048])
def test_files(spark, tmp_path, block):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, ids string, start int").repartition(5)
    tokenfile.write(docs, f"{tmp_path}/f", PATH, block=block)
    got = tokenfile.read(spark, f"{tmp_path}/f", "long", block=block, with_ids=True).orderBy("start").collect()
    tokenizer, start = Tokenizer.from_file(PATH), 0
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())))
    assert len(got) == len(ordered)
    for r, (i, t) in zip(got, ordered, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.id, r.start, r.n_tokens, r.ids) == (i, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)


def test_damage_is_noticed(spark, tmp_path):
    tokenfile.write(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"), f"{tmp_path}/f", PATH)
    (file,) = [p for p in (tmp_path / "f").glob("part-*") if p.stat().st_size]
    data = bytearray(file.read_bytes())
    data[-9] ^= 4
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "part-0").write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        tokenfile.read(spark, f"{tmp_path}/g").collect()


def test_empty_table(spark, tmp_path):
    tokenfile.write(spark.createDataFrame([], "doc_id long, text string"), f"{tmp_path}/f", PATH)
    assert tokenfile.read(spark, f"{tmp_path}/f").collect() == []


def test_checksums_join():
    rng = random.Random(2)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(3000)), rng.randbytes(rng.randrange(3000))
        assert tokenfile.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_query(spark, tmp_path):
    spark.createDataFrame([(i, t) for i, t in rows() if i is not None and i % 3 == 0 and i != 3 and i != 6], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_token_blocks(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
