"""Batches by step number: only the documents and examples that a step asks for are read.

Which block or example stands where in an epoch is arithmetic (``order.permuted``), so any
step of any epoch can be asked for alone. Blocks find their documents through an index of
where each one begins, in buckets of the stream, before any ids are read; the ids lie in
shelves of the stream, and only the shelves asked for are scanned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import hashing
from lexmill.operators.order import permuted
from lexmill.operators.tokens import collated

#: Tokens of the stream that a bucket of the index spans.
BUCKET = 1 << 20


def steps_of(spark: SparkSession, steps: range, batch: int, rank: int, world: int, n_blocks: int) -> DataFrame:
    """``(g, j, epoch, pos)``: which place of which epoch each row of a rank's batches takes."""
    at = f"(((id div {batch}) * {world} + {rank}) * {batch} + id % {batch})"
    rows = spark.range(steps.start * batch, steps.stop * batch)
    return rows.select(F.expr(f"id div {batch}").alias("g"), F.expr(f"id % {batch}").alias("j"), F.expr(f"{at} div {n_blocks}").alias("epoch"), F.expr(f"{at} % {n_blocks}").alias("pos"))


def block_of(pos: Column, n_blocks: int, seed: int, epoch: Column) -> Column:
    """The block at a place of an epoch's order; every block once."""
    return permuted(pos, n_blocks, seed, epoch, "block")


def epoch_begin(seed: int, epoch: Column, length: int) -> Column:
    """Where an epoch's first block begins: blocks lie differently in each."""
    return F.floor(hashing.uniform(seed, "offset", epoch) * length).cast("long")


def holders(index: DataFrame, wanted: DataFrame, span: int, ordinal: str = "ord", bucket: int = BUCKET) -> DataFrame:
    """``wanted`` stretches (from ``start``, ``span`` tokens) with each document of ``index`` that holds a part of them.

    Both sides are listed under the buckets they touch; the later of the two first buckets is
    the one in which a pair counts, so none comes twice.
    """
    def listed(df: DataFrame, low: Column, high: Column) -> DataFrame:
        first = (low - F.pmod(low, F.lit(bucket))) / bucket
        last = (high - F.pmod(high, F.lit(bucket))) / bucket
        return df.withColumn("_first", first.cast("long")).withColumn("_bucket", F.explode(F.sequence(F.col("_first"), last.cast("long"))))

    docs = listed(index.where("n > 0"), F.col("offset"), F.col("offset") + F.col("n") - 1).withColumnRenamed("_first", "_doc_first")
    asked = listed(wanted, F.col("start"), F.col("start") + span - 1)
    both = asked.join(docs, "_bucket").where((F.col("_bucket") == F.greatest("_first", "_doc_first")) & (F.col("offset") < F.col("start") + span) & (F.col("offset") + F.col("n") > F.col("start")))
    return both.drop("_bucket", "_first", "_doc_first")


def stored_batches(spark: SparkSession, path: str, steps: range, batch: int, rank: int, world: int, length: int, seed: int, split: str = "train", ordinal: str = "ord", ids: str = "ids") -> DataFrame:
    """``(g, j, x, y)`` of the steps asked for, a pure function of seed, rank and step, from what ``readers.write_stream`` wrote."""
    from lexmill.sources import readers
    from lexmill.storage import stage

    index = readers.stream_index(spark, path).where(F.col("split") == split)
    total = index.agg(F.sum("n")).first()[0] or 0
    n_blocks = total // length - 1
    if n_blocks < 1:
        raise ValueError(f"{total} tokens are too few for blocks of {length}")
    wanted = steps_of(spark, steps, batch, rank, world, n_blocks)
    start = epoch_begin(seed, F.col("epoch"), length) + block_of(F.col("pos"), n_blocks, seed, F.col("epoch")) * length
    pieces = stage(holders(index, wanted.select("g", "j", start.alias("start")), length + 1, ordinal), "pieces")
    # Each row of a batch touches two shelves, and one more where a long document reaches into them.
    shelves = [r[0] for r in pieces.select("shelf").distinct().collect()]
    rows = readers.read_shelves(spark, path, split, shelves).select(ordinal, F.col(ids).alias("_ids"))
    low, high = F.greatest("start", "offset"), F.least(F.col("start") + length + 1, F.col("offset") + F.col("n"))
    cut = rows.join(pieces, ordinal).select("g", "j", F.struct(low.alias("at"), F.slice("_ids", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("t")).alias("p"))
    block = cut.groupBy("g", "j").agg(F.array_sort(F.collect_list("p")).alias("p")).select("g", "j", F.flatten(F.transform("p", lambda p: p["t"])).alias("t"))
    return block.select("g", "j", F.slice("t", 1, length).alias("x"), F.slice("t", 2, length).alias("y"))


def examples_of(lengths: DataFrame, steps: range, batch: int, seed: int, rank: int = 0, world: int = 1, multiple: int = 32, ordinal: str = "ord", length: str = "n") -> DataFrame:
    """``(g, j, ordinal)``: the examples of each step's batch, over as many epochs as the steps reach.

    ``lengths`` has the ordinals 0, 1, ... of all examples. An epoch's order is cut to whole
    batches on each rank; a rank's part goes in chunks of ``batch * multiple`` that are sorted
    by length, and the batches come in an order of their own. Only the chunks of the batches
    asked for are put together.
    """
    n = lengths.count()
    per_epoch = n // world // batch
    if per_epoch < 1:
        raise ValueError(f"{n} training examples are too few for batches of {batch} on {world} ranks")
    chunk = batch * multiple
    grid = lengths.sparkSession.range(steps.start, steps.stop).select(F.col("id").alias("g"), F.expr(f"id div {per_epoch}").alias("epoch"), F.expr(f"id % {per_epoch}").alias("i"))
    asked = grid.select("g", "epoch", permuted(F.col("i"), per_epoch, seed, F.col("epoch"), "batch").alias("q"))
    begin = F.expr(f"(q div {multiple}) * {chunk}")
    placed = asked.select("g", "epoch", F.expr(f"q % {multiple}").alias("nth"), F.explode(F.sequence(begin, F.least(begin + chunk, F.lit(per_epoch * batch)) - 1)).alias("k"))
    named = placed.select("g", "nth", "k", permuted(F.col("k") * world + rank, n, seed, F.col("epoch"), "example").alias(ordinal))
    within = Window.partitionBy("g").orderBy(length, "k")  # a chunk
    ranked = named.join(lengths.select(ordinal, length), ordinal).withColumn("_r", F.row_number().over(within).cast("long") - 1)
    return ranked.where(F.expr(f"_r div {batch}") == F.col("nth")).select("g", F.expr(f"_r % {batch}").alias("j"), ordinal)


def example_batches(examples: DataFrame, steps: range, batch: int, seed: int, rank: int = 0, world: int = 1, multiple: int = 32, ordinal: str = "ord", ids: str = "ids", mask: str = "mask", length: str | None = None) -> DataFrame:
    """``(g, j, ordinal, x, y)``: padded fine-tuning batches by step; ``length`` names a column that has the sizes without the ids."""
    lengths = examples.select(ordinal, (F.size(ids) if length is None else F.col(length)).alias("n"))
    chosen = examples_of(lengths, steps, batch, seed, rank, world, multiple, ordinal)
    return collated(chosen.join(examples.select(ordinal, ids, mask), ordinal).select("g", "j", ordinal, ids, mask), ["g"], ids, mask)
