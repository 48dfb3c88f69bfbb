"""Connected components of a table of links, without a hot vertex meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.storage import free, stage


def _star(links: DataFrame, kept: str, smaller: bool) -> DataFrame:
    """Neighbours of each vertex v are tied to the smallest of v and all of them; tables in between are freed."""
    least = stage(links.groupBy("v").agg(F.min("u").alias("least")).select("v", F.least("v", "least").alias("least")), "least")
    tied = links.join(least, "v").where(kept).select(F.col("u").alias("v"), F.col("least").alias("u"))
    if smaller:  # v itself too
        tied = tied.unionByName(least.select("v", F.col("least").alias("u"))).where("v <> u")
    out = stage(tied.distinct(), "star")
    free(least)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for each linked vertex: the smallest vertex that it reaches.

    Alternates large-star (larger neighbours go to the smallest) and small-star (a vertex and
    its smaller neighbours do) until the links no longer change (Kiveris et al., 2014), which
    takes rounds in the order of the squared logarithm of the vertices. Each round is written,
    so lineage stays short, and the one before is freed.
    """
    at = stage(links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct(), "links")
    before = None
    while (mark := at.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()) != before:
        before = mark
        large = _star(at.unionByName(at.select(F.col("u").alias("v"), F.col("v").alias("u"))), "u > v", smaller=False)
        small = _star(large, "u <> least", smaller=True)
        free(at, large)
        at = small
    return at.select(F.col("v").alias("id"), F.col("u").alias("component"))
