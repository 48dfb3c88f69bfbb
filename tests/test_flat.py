"""Flat files: written and read back, mapped as numpy maps them, guards, and a commit that doesn't happen."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import lookup, order
from lexmill.sources import flat


def stream(spark, top=900):
    return spark.createDataFrame([("val" if i % 7 == 0 else "train", i, [(i * 31 + k) % top for k in range(i % 23)]) for i in range(300)], "split string, ord long, ids array<int>").repartition(6)


def joined(rows, split):
    return [t for r in sorted(rows, key=lambda r: r.ord) if r.split == split for t in r.ids]


@pytest.mark.parametrize(("vocabulary", "kind"), [(900, "uint16"), (70_000, "uint32")])
def test_streams(spark, tmp_path, vocabulary, kind):
    docs = stream(spark, vocabulary)
    totals = flat.write_stream(docs, f"file://{tmp_path}/s", vocabulary, meta={"tokenizer": "own"})
    rows = docs.collect()
    for split in ("train", "val"):
        want = joined(rows, split)
        assert np.fromfile(tmp_path / "s" / f"{split}.bin", kind).tolist() == want and totals[split][1] == len(want)
        got = flat.read(spark, f"{tmp_path}/s", split=split, rowIds=50, partBytes=400).orderBy("first").collect()
        assert [t for r in got for t in r.ids] == want and [r.first for r in got] == list(range(0, len(want), 50))
    both = flat.read(spark, f"{tmp_path}/s", rowIds=50, partBytes=400)
    assert both.rdd.getNumPartitions() > 4 and {r.split for r in both.collect()} == {"train", "val"}
    assert sorted(os.listdir(tmp_path / "s")) == ["meta.json", "train.bin", "val.bin"]
    assert json.load(open(tmp_path / "s" / "meta.json"))["tokenizer"] == "own"


def test_files_of_other_programs(spark, tmp_path):
    np.arange(1000, dtype="<u2").tofile(tmp_path / "train.bin")
    np.arange(30, dtype="<u2").tofile(tmp_path / "val.bin")
    (tmp_path / "meta.json").write_text('{"dtype": "uint16", "padded_vocab_size": 1024}')
    got = flat.read(spark, str(tmp_path), split="train", rowIds=64).orderBy("first").collect()
    assert [t for r in got for t in r.ids] == list(range(1000))
    assert flat.checked(str(tmp_path), 16)["padded_vocab_size"] == 1024
    with pytest.raises(ValueError, match="validation"):
        flat.checked(str(tmp_path), 30)
    with pytest.raises(ValueError, match="training"):
        flat.checked(str(tmp_path), 600)


def test_examples(spark, tmp_path):
    rows = [("val" if i % 9 == 0 else "train", i, list(range(i % 13)), [k % 2 for k in range(i % 13)]) for i in range(200)]
    df = spark.createDataFrame(rows, "split string, ord long, ids array<int>, mask array<tinyint>").repartition(5)
    flat.write_examples(df, str(tmp_path / "e"), 900)
    for split in ("train", "val"):
        own = [r for r in rows if r[0] == split]
        ids, mask, offsets = (np.load(tmp_path / "e" / f"{split}.{n}.npy") for n in ("tokens", "mask", "offsets"))
        assert (ids.dtype, mask.dtype, offsets.dtype) == (np.uint16, np.uint8, np.int64)
        assert offsets.tolist() == [0, *np.cumsum([len(r[2]) for r in own]).tolist()]
        assert ids.tolist() == [t for r in own for t in r[2]] and mask.tolist() == [t for r in own for t in r[3]]
        got = flat.read(spark, str(tmp_path / "e"), split=split, partBytes=300).orderBy("ord").collect()
        assert [(r.ord, r.ids, list(r.mask)) for r in got] == [(k, r[2], r[3]) for k, r in enumerate(own)]
    batches = lookup.example_batches(order.numbered(flat.read(spark, str(tmp_path / "e"), split="train").where(F.size("ids") > 1).select("ids", "mask", F.col("ord").alias("old")), F.col("old")), range(3), 4, 1)
    assert batches.count() == 12
    with pytest.raises(ValueError, match="too few"):
        flat.checked(str(tmp_path / "e"), batch=200)


def test_stretches_read_their_bytes(spark, tmp_path):
    docs = stream(spark)
    flat.write_stream(docs, str(tmp_path / "s"), 900)
    want = joined(docs.collect(), "train")
    wanted = spark.createDataFrame([(i, s) for i, s in enumerate((0, 5, 700, len(want) - 17))], "i int, start long")
    assert {r.i: r.ids for r in flat.stretches(wanted, str(tmp_path / "s"), 17).collect()} == {r.i: want[r.start : r.start + 17] for r in wanted.collect()}


def test_empty_splits_and_tables(spark, tmp_path):
    flat.write_stream(stream(spark).where("split = 'train' and ord < 5"), str(tmp_path / "s"), 900)
    assert os.path.getsize(tmp_path / "s" / "val.bin") == 0 and flat.read(spark, str(tmp_path / "s"), split="val").count() == 0
    flat.write_stream(stream(spark).limit(0), str(tmp_path / "t"), 900)
    assert flat.read(spark, str(tmp_path / "t")).collect() == []


def test_what_fails_leaves_the_old_files(spark, tmp_path):
    path = str(tmp_path / "s")
    flat.write_stream(stream(spark), path, 900)
    before = {n: (tmp_path / "s" / n).read_bytes() for n in os.listdir(path)}
    with pytest.raises(Exception, match="fit"):
        flat.write_stream(stream(spark).withColumn("ids", F.array(F.lit(70_000))), path, 900)
    assert {n: (tmp_path / "s" / n).read_bytes() for n in os.listdir(path)} == before
    writer = flat.Writer({"path": path, "mode": flat.STREAM, "kind": "uint16", "totals": '{"train": [3, 3]}'})
    with pytest.raises(ValueError, match="announced"):
        writer.commit([flat.Written({"train": 2}, {"train": 2})])
    with pytest.raises(ValueError, match="mounted"):
        flat.local_path("s3://bucket/x")


def test_a_task_that_runs_again_writes_the_same(tmp_path):
    import pyarrow as pa

    rows = [("train", 0, 0, [1, 2, 3]), ("train", 3, 1, []), ("train", 3, 2, [4]), ("train", 4, 3, [5, 6])]
    batch = pa.RecordBatch.from_pylist([{"split": s, "offset": o, "place": p, "ids": i} for s, o, p, i in rows], pa.schema([("split", pa.string()), ("offset", pa.int64()), ("place", pa.int64()), ("ids", pa.list_(pa.int64()))]))
    writer = flat.Writer({"path": str(tmp_path), "mode": flat.STREAM, "kind": "uint16", "totals": '{"train": [4, 6]}'})
    late, early = writer.write(iter([batch.slice(2)])), writer.write(iter([batch.slice(0, 2)]))
    writer.write(iter([batch.slice(2)]))  # the same again
    writer.commit([early, late])
    assert np.fromfile(tmp_path / "train.bin", "<u2").tolist() == [1, 2, 3, 4, 5, 6]
