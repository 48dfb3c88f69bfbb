"""Pairs between the pipeline's bound and that of the op10 query."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import neardup


def shingles(text):
    words = text.split(" ")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


@pytest.fixture(scope="module")
def pairs():
    """Pairs of texts with a similarity from 0.74 to 0.92; ids 2 k and 2 k + 1."""
    rng, out = random.Random(7), []
    for k in range(300):
        n = rng.choice([60, 150, 400, 1200])
        words = [f"p{k}w{i}" for i in range(n)]
        while True:
            other = list(words)
            for at in rng.sample(range(n), max(1, round(n * rng.uniform(0.008, 0.04)))):
                other[at] = f"p{k}x{at}"
            a, b = " ".join(words), " ".join(other)
            if 0.74 <= jaccard(a, b) <= 0.92:
                break
        out.append((a, b))
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_threshold(spark, pairs, percent):
    df = spark.createDataFrame([(2 * k + j, t) for k, pair in enumerate(pairs) for j, t in enumerate(pair)], "doc_id long, text string")
    gone = {r.doc_id for r in neardup.near_duplicates(df, threshold=percent).where("not kept").collect()}
    assert gone == {2 * k + 1 for k, (a, b) in enumerate(pairs) if 100 * jaccard(a, b) >= percent}


def test_pipeline_stage(spark, pairs):
    import corpus_pipeline

    between = [p for p in pairs if 0.8 <= jaccard(*p) < 0.85]
    assert len(between) > 30
    df = spark.createDataFrame([(2 * k + j, t) for k, pair in enumerate(between) for j, t in enumerate(pair)], "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.duplicates(spark, df, "").collect()}
    assert left == {2 * k for k in range(len(between))}


def test_bands_miss_no_pair_at_the_threshold():
    for percent in (80, 85):
        bound = neardup.Bound(percent)
        assert (1 - (percent / 100) ** bound.rows) ** bound.bands < 1e-6


def bucket(spark, n, others):
    """One bucket of n members, of which some ask."""
    rows = spark.range(n).select(F.lit(5).cast("long").alias("key"), "id", F.lit(n).cast("long").alias("all"), F.lit(others).cast("long").alias("others"), F.xxhash64("id").alias("h"))
    return neardup.dealt(rows.where(F.col("id") < others), rows, ["key", "id"], neardup.sketch_chunks, "h")


@pytest.mark.parametrize(("n", "others"), [(100_000, 100_000), (100_000, 30_000), (1_000_000, 500_000)])
def test_sketch_rows_grow_with_the_bucket(spark, n, others):
    cells = bucket(spark, n, others)
    assert cells.count() <= (n + others) * neardup.CHUNKS
    assert cells.where("asks").groupBy("u", "v").count().agg(F.max("count")).first()[0] <= 1.2 * others / neardup.CHUNKS


@pytest.mark.parametrize(("n", "others"), [(1, 1), (2, 1), (399, 12), (900, 850), (7000, 300)])
def test_each_pair_meets_in_one_cell(spark, n, others):
    cells = bucket(spark, n, others)
    one, two = cells.where("asks").select("u", "v", F.col("id").alias("a")), cells.where("not asks").select("u", "v", F.col("id").alias("b"))
    met = one.join(two, ["u", "v"])
    assert met.count() == n * others == met.select("a", "b").distinct().count()


@pytest.mark.parametrize(("cell", "chunks", "largest"), [(400, 16, 1 << 16), (2, 3, 7), (1, 1, 1 << 16)])
def test_hot_buckets_lose_no_link(spark, monkeypatch, cell, chunks, largest):
    """Texts that share a passage and so their buckets; some are alike enough, in chains that no star finds whole."""
    for name, value in (("CELL", cell), ("CHUNKS", chunks), ("LARGEST", largest)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(11)
    passage, tails, texts = [f"p{i}" for i in range(200)], [[f"t{g}x{i}" for i in range(60)] for g in range(30)], []
    for k in range(240):
        tail = list(tails[k % 30])
        for at in range(0, rng.choice([0, 10, 25, 50])):
            tail[at] = f"own{k}x{at}"
        texts.append(" ".join(passage + tail))
    sets, up = [shingles(t) for t in texts], list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                one, two = sorted((top(a), top(b)))
                up[two] = one
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df).collect()}
    assert got == {i: top(i) for i in range(len(texts))} and 30 <= len(set(got.values())) < 200
