"""The pipeline's stages, each against what its operator says of its own input."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline as p
    from lexmill.llm import bpe, mix, neardup, quality
    from lexmill.llm.queries import vocabulary

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, at = docs.columns, {}
    for i, (name, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{i}")
        out = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == len(p.STAGES) - 1 or out.columns == columns + [p.PLACE] * (name == "mixture")
        at[name] = (docs, out)
        docs = out
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    before, after = at["language"]
    assert ids(after) == ids(before.where(F.col("text").rlike(r"\p{L}")))
    before, after = at["rules"]
    judged = quality.judge(before, spark.read.parquet(f"{DATA}/labels.parquet")).where("kept")
    assert ids(after) == ids(judged)
    before, after = at["duplicates"]
    assert ids(after) == ids(neardup.near_duplicates(before, threshold=p.NEAR).where("kept"))
    before, after = at["mixture"]
    taken = {r.doc_id: (r.taken / r["size"], len(r.slots)) for r in mix.mix(before).collect() if r["size"]}
    got = ids(after)
    assert all(got[i] == n and abs(n - times) < 1 + 1e-9 for i, (times, n) in taken.items()) and sum(got.values()) > 0 and set(got) <= set(taken)
    before, after = at["encoding"]
    codec = bpe.Codec(bpe.load_ranks(vocabulary("byte_bpe_multi_50k.tiktoken")))
    text = {r.doc_id: r.text for r in before.collect()}
    assert all(codec.decode(list(r.token_ids)) == text[r.doc_id] and r.n_tokens == len(r.token_ids) for r in after.collect())
    assert ids(after) == ids(before)
    order = lambda df: [(r[p.PLACE], r.doc_id) for r in df.select(p.PLACE, "doc_id").collect()]
    assert sorted(order(after)) == sorted(order(before)) and after.columns == ["doc_id", p.PLACE, "n_tokens", "token_ids"]


def test_run(spark):
    import corpus_pipeline as p

    rows = p.run(spark, DATA).select(p.PLACE).collect()
    assert rows and len({r[0] for r in rows}) == len(rows)  # each place of the mix is one row's
