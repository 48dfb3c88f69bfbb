"""``bpe_tokens`` decodes the ids of whole texts again and tells whether they give the text."""

import hashlib
import unicodedata

import pytest

from lexmill.operators import bpe_training
from lexmill.plans import catalog

TEXTS = ["Un mot, un mot’s", "日本 mot 🙂", "e\u0301te\u0301 été", "é<|x ", "", "ab " * 20_000, "x" * 30_000]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("decodes"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def test_texts_decode_to_themselves(spark, folder):
    own = [unicodedata.normalize("NFC", t.replace("<|", "< |")) for t in TEXTS]
    found = {r.doc_id: (r.decodes, r.digest) for r in catalog.QUERIES["bpe_tokens"](spark, folder).collect()}
    assert found == {i: (x == t, hashlib.md5(x.encode()).hexdigest()) for i, (x, t) in enumerate(zip(own, TEXTS, strict=True))}
    assert {i for i, (same, _) in found.items() if not same} == {2, 3}


def test_ids_that_lose_a_text_are_told(spark, folder, monkeypatch):
    def lossy(learned, make=bpe_training.Tokenizer):
        made = make([])
        made.id_of[b"b"] = made.id_of[b"a"]
        return made

    monkeypatch.setattr(bpe_training, "Tokenizer", lossy)
    found = {r.doc_id: (r.n_tokens, r.decodes) for r in catalog.QUERIES["bpe_tokens"](spark, folder).collect()}
    assert found[5] == (60_000, False) and found[6] == (30_000, True) and found[4] == (0, True)


def test_decoded_columns(spark):
    own = bpe_training.Tokenizer([(b"m", b"o"), (b"mo", b"t")])
    ids = [own.word("mot"), [0, *own.word("été"), 4], [0xC3 + 5, 0x41 + 5], [], None]
    rows = spark.createDataFrame(list(enumerate(ids)), "i long, ids array<int>")
    for skip in (True, False):
        found = {r.i: r.t for r in rows.select("i", own.decode_col(rows["ids"], skip).alias("t")).collect()}
        assert found == {i: None if x is None else own.decode(x, skip) for i, x in enumerate(ids)}
