"""Batches by step: the permutation, the documents that a step reads, examples over the borders of epochs."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import lookup, order
from lexmill.sources import readers


def places(n, *key):
    """The permutation spelled out: a grid, four moves of one coordinate by a hash of the other, again while beyond n."""
    low = math.ceil(math.sqrt(n))
    a = min(range(low, low + 64), key=lambda s: (s * math.ceil(n / s) - n, s))
    b = math.ceil(n / a)
    number = lambda *x: int(hashlib.md5(":".join(map(str, [*key, *x])).encode()).hexdigest()[:8], 16)

    def through(v):
        x, y = divmod(v, b)
        for r in range(0, 4, 2):
            x = (x + number(r, y)) % a
            y = (y + number(r + 1, x)) % b
        return x * b + y

    out = []
    for v in range(n):
        v = through(v)
        while v >= n:
            v = through(v)
        out.append(v)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 13, 64, 97, 1000, 1009, 4999])
def test_every_place_once(spark, n):
    got = [r[0] for r in spark.range(n).orderBy("id").select(order.permuted(F.col("id"), n, 3, "a")).collect()]
    assert got == places(n, 3, "a") and sorted(got) == list(range(n))


def test_keys_give_other_orders_and_grids_are_tight(spark):
    seen = {tuple(r[0] for r in spark.range(50).orderBy("id").select(order.permuted(F.col("id"), 50, 3, F.lit(e))).collect()) for e in range(4)}
    assert len(seen) == 4
    for n in (10**6 + 3, 10**9 + 7, 10**12 + 39):
        a, b = order.grid(n)
        assert n <= a * b <= n + math.isqrt(n) + 64


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('stream')}/s"
    docs = spark.createDataFrame([("train", i, [(i * 7 + k) % 1000 for k in range(2500 if i == 30 else i % 40 + 1)]) for i in range(200)] + [("train", 900, []), ("val", 901, [5] * 50)], "split string, ord long, ids array<int>")
    readers.write_stream(docs, path, shelf=400)
    flat = [t for r in docs.where("split = 'train'").orderBy("ord").collect() for t in r.ids]
    return path, flat


def test_batches_are_pure_and_ranks_differ(spark, stream, monkeypatch):
    path, flat = stream
    monkeypatch.setattr(lookup, "BUCKET", 100)
    length, seed = 16, 7
    n = len(flat) // length - 1
    run = lambda rank, steps: {(r.g, r.j): (r.x, r.y) for r in lookup.stored_batches(spark, path, steps, 4, rank, 2, length, seed).collect()}
    zero, one = run(0, range(100)), run(1, range(100))
    assert len(zero) == len(one) == 400 and zero != one and run(0, range(60, 63)) == {k: v for k, v in zero.items() if 60 <= k[0] < 63}
    orders = {e: places(n, seed, e, "block") for e in range(4)}
    for rank, got in ((0, zero), (1, one)):
        for (g, j), (x, y) in got.items():
            epoch, pos = divmod((g * 2 + rank) * 4 + j, n)
            begin = int(int(hashlib.md5(f"{seed}:offset:{epoch}".encode()).hexdigest()[:8], 16) / 2**32 * length)
            at = begin + orders[epoch][pos] * length
            assert x == flat[at : at + length] and y == flat[at + 1 : at + length + 1]
    assert {(g * 2 * 4) // n for g, _ in zero} > {0}  # more than one epoch
    with pytest.raises(ValueError, match="too few"):
        lookup.stored_batches(spark, path, range(1), 1, 0, 1, 10**6, 7)


def test_only_the_shelves_asked_for_are_read(spark, stream):
    path, flat = stream
    index = readers.stream_index(spark, path).where("split = 'train'")
    assert index.count() == 201
    wanted = spark.createDataFrame([(0, 0, 1300)], "g long, j long, start long")
    pieces = lookup.holders(index, wanted, 17)
    covered = sorted((r.offset, r.offset + r.n) for r in pieces.collect())
    assert covered[0][0] <= 1300 < covered[0][1] and covered[-1][0] < 1317 <= covered[-1][1] and all(a[1] == b[0] for a, b in zip(covered, covered[1:], strict=False))
    read = readers.read_shelves(spark, path, "train", sorted({r.shelf for r in pieces.collect()}))
    shelf_of = {r.ord: r.shelf for r in index.collect()}
    on_shelves = [o for o, s in shelf_of.items() if s in {r.shelf for r in pieces.collect()}]
    assert sorted(r.ord for r in read.collect()) == sorted(on_shelves) and len(on_shelves) < 60
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "shelf" in plan.split("PartitionFilters")[1].split("]")[0]
    # A stretch that begins inside a very long document finds it on the shelf where it began.
    inside = lookup.holders(index, spark.createDataFrame([(0, 0, 2500)], "g long, j long, start long"), 17).collect()
    assert [r.ord for r in inside] == [30]


def test_examples_by_step(spark):
    n, batch, world, multiple, seed = 103, 6, 2, 3, 5
    rows = spark.createDataFrame([(i, [i] * (2 + i * 37 % 101), [0] + [1] * (1 + i * 37 % 101)) for i in range(n)], "ord long, ids array<int>, mask array<int>")
    per = n // world // batch
    for rank in range(world):
        got = lookup.example_batches(rows, range(5, 21), batch, seed, rank, world, multiple).collect()
        for g in range(5, 21):
            epoch, i = divmod(g, per)
            own = places(n, seed, epoch, "example")[: per * batch * world][rank::world]
            q = places(per, seed, epoch, "batch")[i]
            chunk = own[q // multiple * batch * multiple :][: batch * multiple]
            chunk = sorted(chunk, key=lambda e: (2 + e * 37 % 101, own.index(e)))
            want = chunk[q % multiple * batch :][:batch]
            mine = sorted((r for r in got if r.g == g), key=lambda r: r.j)
            assert [r.ord for r in mine] == want
            most = max(1 + e * 37 % 101 for e in want)
            for r in mine:
                k = 1 + r.ord * 37 % 101
                assert r.x == [r.ord] * k + [0] * (most - k) and r.y == [r.ord] * k + [-1] * (most - k)
    whole = lookup.examples_of(rows.select("ord", F.size("ids").alias("n")), range(per, 2 * per), batch, seed, 1, world, multiple).collect()
    assert Counter(Counter(r.ord for r in whole).values()) == {1: per * batch}  # an epoch has each example once at most
    with pytest.raises(ValueError, match="too few"):
        lookup.examples_of(rows.select("ord", F.lit(1).alias("n")), range(1), 60, seed, 0, 2)
