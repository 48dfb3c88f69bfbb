"""The stage ``encoding`` decodes what it encoded, and fails where that isn't the text."""

import base64

import pytest


def test_ids_that_lose_a_text_fail(spark, tmp_path, monkeypatch):
    import corpus_pipeline as p

    encoding = dict(p.STAGES)["encoding"]
    lines = [(bytes([b]), 0x61 if b == 0x62 else b) for b in range(256)]  # "a" and "b" have one rank
    (tmp_path / "byte_bpe_multi_50k.tiktoken").write_bytes(b"".join(b"%s %d\n" % (base64.b64encode(t), rank) for t, rank in lines))
    monkeypatch.setenv("LEXMILL_VOCABULARIES", str(tmp_path))
    make = lambda text: spark.createDataFrame([(1, text, "en", "s", 3), (2, None, "en", "s", 4)], "doc_id long, text string, lang string, source string, mix_slot long")
    kept = {r.doc_id: (r.mix_slot, r.n_tokens, r.token_ids) for r in encoding(spark, make("x y"), "").collect()}
    assert kept == {1: (3, 3, [0x78, 0x20, 0x79]), 2: (4, 0, [])}
    with pytest.raises(Exception, match="don't decode"):
        encoding(spark, make("x ab"), "").collect()
