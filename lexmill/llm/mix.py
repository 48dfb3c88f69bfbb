"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source is a line of its documents in hashed order, cut into blocks of equally many words.
Slot t of the schedule takes the point ``frac((t + 1) * golden ratio)`` through the cumulative
shares of the sources, which are the blocks that their targets come to. The source whose share
holds the point gets the slot; slots are ranked inside their source, and the r-th takes the
r-th block, starting over at the line's end. So the points alone decide how often each block
is taken and when. Any run of slots has each source within a few blocks of its share, and so
has the whole mix; what a source would get beyond three times its line is left out.

There are as many slots as the words come to in blocks of ``block_words`` (2048), but at least
``least_slots``: blocks of small tables are shorter, which keeps a few of them a small share.

All prefix sums and ranks are two-level (inside bounded buckets, then over the buckets), so a
hot source doesn't meet in one task. Sources are rows of a table from their sums to their shares
of the unit interval, so there may be as many as a corpus has domains; the driver gets totals.

Defined results: null and empty texts have no words and are never taken; the null source comes
last; a source without words has target 0; repeated rows are told apart by an ordinal among
equal rows and taken each for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.operators.order import BUCKET, numbered
from lexmill.storage import stage

#: Weights by place in the order of sources, and how often a source may be read.
WEIGHTS, MOST_EPOCHS = (5.0, 2.0, 1.0), 3
#: 2**64 divided by the golden ratio, made odd: its multiples mod 2**64 are the points.
GOLDEN = 0x9E3779B97F4A7C15
#: Parts of the unit interval by which points find their source, at least; there are more for many sources.
CELLS = 1024
#: Shares are whole numbers of such parts of a block: their sums are exact, so the interval has no gaps.
UNITS = 1 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, key: str, bucket: str, order: list, size: str, out: str) -> DataFrame:
    """``out``: the sum of ``size`` over earlier rows of the same key, by buckets that each fit a task."""
    within = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(key, bucket).agg(F.sum(size).alias("_s")).select(key, bucket, F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_0"))
    return df.withColumn("_b", F.sum(size).over(within) - F.col(size)).join(sums, [key, bucket]).withColumn(out, F.col("_0") + F.col("_b")).drop("_0", "_b")


def whole(df: DataFrame, place: str, size: str, out: str) -> DataFrame:
    """``out``: the sum of ``size`` over all rows with a smaller ``place``, of which there are 0, 1, ..."""
    return running(df.withColumn("_all", F.lit(0)).withColumn("_at", F.expr(f"{place} div {BUCKET}")), "_all", "_at", [place], size, out).drop("_all", "_at")


def targets(sums: DataFrame, weights=WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """``(name, size, ...)`` of each source with ``source``, its number in the order of names, and ``target``.

    All sources share the sum of sizes by weight, and none gets more than ``most`` times its
    size: a target is the weight times a level that all have in common, or that bound. In the
    order in which a rising level reaches their bounds, the first source whose bound isn't
    reached by what those before it leave gives the level.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source") % len(weights) + 1).cast("int"))
    placed = numbered(sums, F.col("name").isNull(), F.col("name"), out="source").withColumn("_weight", weight).withColumn("_most", F.lit(float(most)) * F.col("size"))
    filled = whole(whole(numbered(placed, F.col("_most") / F.col("_weight"), F.col("source"), out="_place"), "_place", "_most", "_full"), "_place", "_weight", "_lighter")
    filled = stage(filled, "mix-levels")
    words, heavy = filled.agg(F.sum("size"), F.sum("_weight")).first()
    free = F.lit(heavy or 0.0) - F.col("_lighter")
    enough = F.col("_full") + F.col("_most") / F.col("_weight") * free >= float(words or 0)
    level = filled.where(enough).agg(F.min(F.struct("_place", (F.lit(float(words or 0)) - F.col("_full")).alias("left"), free.alias("free"))).alias("level")).first().level
    target = F.least("_most", F.lit(level.left) * F.col("_weight") / F.lit(level.free)) if level else F.col("_most")
    return filled.select(*sums.columns, "source", target.alias("target"))


def points(spark: SparkSession, slots: int, seed: int, step: int) -> DataFrame:
    """``(slot, u)``: the points ``frac((slot + seed + 1) * step / 2**64)`` to 53 bits."""
    parts = max(1, min(10_000, slots // 200_000 + 1))
    step, half = step >> 11, 1 << 26  # in 2**53 steps of the unit interval
    t = f"(id + {seed + 1})"
    # (t * step) mod 2**53 without leaving 64 bits: t is split at 26 bits.
    low = f"({t} & {half - 1}) * {step % (1 << 27)} + shiftleft((({t} & {half - 1}) * {step >> 27}) & {half - 1}, 27)"
    high = f"shiftleft(((shiftright({t}, 26) & {(1 << 27) - 1}) * {step & ((1 << 27) - 1)}) & {(1 << 27) - 1}, 26)"
    return spark.range(0, slots, 1, parts).select(F.col("id").alias("slot"), F.expr(f"pmod(({low}) + ({high}), {1 << 53}) / {float(1 << 53)!r}D").alias("u"))


def schedule(owed: DataFrame, seed: int = 0, bucket_slots: int = 1 << 16, step: int = GOLDEN) -> DataFrame:
    """``(slot, source, turn)`` and further columns of ``owed``: which source each slot takes, and that source's how-manieth slot it is.

    ``owed`` has each source's number of blocks by ``source``, its number from 0; there are as
    many slots as all of them come to.
    """
    spark = owed.sparkSession
    shares = owed.withColumn("_units", F.coalesce(F.round(F.col("owed") * UNITS), F.lit(0)).cast("long"))
    shares = stage(whole(shares, "source", "_units", "_from").where("_units > 0"), "mix-shares")
    total, n = shares.agg(F.sum("_units"), F.count("*")).first()
    total, cells = total or 0, max(CELLS, 1 << (4 * n).bit_length())
    shares = shares.withColumn("lo", F.col("_from") / F.lit(max(total, 1))).withColumn("hi", (F.col("_from") + F.col("_units")) / F.lit(max(total, 1)))
    # One row for each source, and at most one more for each cell; points are even, so no cell is hot.
    parts = shares.drop("owed", "_from", "_units").withColumn("_cell", F.explode(F.expr(f"sequence(cast(floor(lo * {cells}) as long), cast(floor(hi * {cells}) as long))")))
    drawn = points(spark, (total + UNITS // 2) // UNITS, seed, step).withColumn("_cell", F.expr(f"cast(floor(u * {cells}) as long)"))
    found = drawn.join(parts, "_cell").where("u >= lo and u < hi").drop("u", "lo", "hi", "_cell")
    found = found.withColumn("_bucket", F.expr(f"slot div {bucket_slots}")).withColumn("_1", F.lit(1).cast("long"))
    return running(found, "source", "_bucket", ["slot"], "_1", "turn").drop("_bucket", "_1")


def mix(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block_words: int = 2048, least_slots: int = 1 << 16, bucket_rows: int = 4_000, seed: int = 0, step: int = GOLDEN
) -> DataFrame:
    """``(id, row_hash, size, source_size, target, taken, slots)`` for each row of ``docs``.

    ``taken`` counts the words that the mix takes. ``slots`` are the places at which it comes
    to the row's first word, one for each time. ``row_hash`` tells rows that share an id apart
    by their text and source.
    """
    sized = stage(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("name"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col, source_col).alias("row_hash")), "mix-sizes"
    )
    shared = targets(sized.groupBy("name").agg(F.sum("size").alias("size"), F.count("*").alias("rows")))
    shared = shared.withColumnRenamed("size", "source_size")
    words = shared.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, min(block_words, words // least_slots))
    # A line's last block may be short: what a source owes is counted in lines, each of so many blocks.
    shared = shared.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}"))
    facts = stage(shared.withColumn("owed", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks"))), "mix-sources")
    # Spark broadcasts sources where its threshold says so; beyond it both sides are shuffled, and a hot source's narrow rows are split.
    known = facts.select(F.col("name").alias("_name"), "source", "source_size", "target", F.expr(f"rows div {bucket_rows} + 1").alias("buckets"))
    named = sized.join(known, F.col("name").eqNullSafe(F.col("_name"))).drop("name", "_name")
    ordered = named.groupBy("id", "row_hash", "source", "size", "source_size", "target", "buckets").agg(F.count("*").alias("_n"))
    ordered = ordered.withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n")
    ordered = ordered.withColumn("h", F.xxhash64(F.lit(seed), "id", "row_hash", "ordinal"))
    ordered = ordered.withColumn("_bucket", F.expr("cast(floor((h / 18446744073709551616D + 0.5D) * buckets) as int)"))
    line = stage(running(ordered, "source", "_bucket", ["h", "id", "row_hash", "ordinal"], "size", "at"), "mix-line")
    taken = (
        schedule(facts.select("source", "owed", "blocks"), seed, step=step)
        .where(F.col("turn") < MOST_EPOCHS * F.col("blocks"))
        .groupBy("source", F.expr("turn % blocks").alias("block"))
        .agg(F.sort_array(F.collect_list("slot")).alias("slots"))  # at most three
    )
    key = ["_id", "row_hash", "source", "ordinal"]
    line = line.withColumn("_id", F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.lit("null")))  # joins don't match nulls
    pieces = line.where("size > 0").select(*key, "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    overlap = f"(least(at + size, (block + 1) * {block}) - greatest(at, block * {block}))"
    got = (
        pieces.join(taken, ["source", "block"])
        .groupBy(*key)
        .agg(F.sum(F.expr(f"size(slots) * {overlap}")).alias("taken"), F.max(F.when(F.expr(f"block = at div {block}"), F.col("slots"))).alias("slots"))
    )
    none = F.array().cast("array<long>")
    return line.join(got, key, "left").select(F.col("id").alias(id_col), "row_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", none).alias("slots"))
