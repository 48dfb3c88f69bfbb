"""Positions and prefix sums over a whole table, without one task that holds it.

An ordinal column gives the order. Sums go in two levels: inside buckets of consecutive
ordinals, and over the buckets' totals.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lexmill.functions import hashing

BUCKET = 4096


def running_sum(df: DataFrame, ordinal: str, value: str | Column, out: str, by: list[str] | None = None, bucket: int = BUCKET) -> DataFrame:
    """``out``: the sum of ``value`` over rows with a smaller ordinal, for each group of ``by``."""
    by = by or []
    value = F.col(value) if isinstance(value, str) else value
    rows = df.withColumn("_bucket", F.expr(f"{ordinal} div {bucket}")).withColumn("_value", value.cast("long"))
    totals = rows.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    over = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row a bucket
    starts = totals.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*by, "_bucket").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_inside", F.sum("_value").over(within) - F.col("_value"))
    return summed.join(starts, [*by, "_bucket"]).withColumn(out, F.col("_start") + F.col("_inside")).drop("_bucket", "_value", "_inside", "_start")


def ranged(df: DataFrame, *order: Column | str, by: list[str] | None = None, label: str = "ranged") -> DataFrame:
    """``df`` with ``_part``: ranges of the order, as many as the session deals shuffles to. Written, so all uses see the same borders."""
    from lexmill.storage import stage

    return stage(df.repartitionByRange(*(by or []), *order).withColumn("_part", F.spark_partition_id()), label)


def numbered(df: DataFrame, *order: Column, out: str = "ord", by: list[str] | None = None) -> DataFrame:
    """``out``: 0, 1, ... in the given order, for each group of ``by``: inside ranges, and over the ranges' counts."""
    by = by or []
    cut = ranged(df, *order, by=by, label="numbered")
    counts = cut.groupBy(*by, "_part").agg(F.count("*").alias("_n"))  # one row for each range, and group in it
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(b).alias(f"_by_{b}") for b in by], F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)).cast("long") - 1
    same = F.col("_part") == F.col("_at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    placed = cut.withColumn("_inside", inside).join(starts, same)
    return placed.withColumn(out, F.col("_start") + F.col("_inside")).select(*df.columns, out)


def shuffled(df: DataFrame, seed: int, *key: str, out: str = "pos", by: list[str] | None = None) -> DataFrame:
    """``out``: each row's place in an order by seed, for each group of ``by``. ``key`` identifies a row."""
    return numbered(df, hashing.order_key(seed, *[F.col(k) for k in key]), *[F.col(k) for k in key], out=out, by=by)


#: Rounds of the permutation, and how many shapes of its grid are tried.
ROUNDS, SHAPES = 4, 64


def grid(n: int) -> tuple[int, int]:
    """Sides of a nearly square grid with n places and as few more as possible."""
    low = math.isqrt(max(n, 1) - 1) + 1
    return min(((a, -(-n // a)) for a in range(low, low + SHAPES)), key=lambda s: (s[0] * s[1] - n, s[0]))


def permuted(place: Column, n: int, *key) -> Column:
    """Where a keyed permutation of 0 to n - 1 takes ``place``: by arithmetic alone, without an order of all places.

    A Feistel network over a grid of n places or a few more: each round moves one coordinate by
    a hash of the other. A result beyond n is taken through it again, which ends after as many
    rounds as there are places too many.
    """
    a, b = grid(n)
    number = T.LongType()

    def hashed(r: Column, half: Column) -> Column:
        return F.conv(F.substring(hashing.order_key(*key, r, half), 1, 8), 16, 10).cast(number)

    def moved(at: Column, r: Column) -> Column:
        x, y = at["x"], at["y"]
        return F.when(r % 2 == 0, F.struct(((x + hashed(r, y)) % a).alias("x"), y.alias("y"))).otherwise(F.struct(x.alias("x"), ((y + hashed(r, x)) % b).alias("y")))

    def network(v: Column) -> Column:
        start = F.struct(((v - v % b) / b).cast(number).alias("x"), (v % b).alias("y"))  # the quotient is whole, so exact below 2^53
        return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, moved, lambda at: at["x"] * b + at["y"])

    first = network(place.cast(number))
    if a * b == n:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - n)), first, lambda v, _: F.when(v < n, v).otherwise(network(v)))
