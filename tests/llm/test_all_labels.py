"""Cutoffs count every label, however many there are."""

from pyspark.sql import functions as F

from lexmill.llm import quality


def test_small_stratum_among_many_labels(spark):
    """700 good labels certify a cutoff with no loss (0.99^n <= 0.05/5/2 from n = 528); a thinned part of them doesn't."""
    n, small = 300_000, 700
    at = spark.range(n)
    rare = F.col("id") < small
    bad = F.col("id") % 10 == 9
    measured = at.select(
        F.col("id").alias("doc_id"),
        F.when(rare | (F.col("id") >= n - 100), "rare").otherwise("common").alias("stratum"),
        F.lit(False).alias("base_failed"),
        *[F.when(~rare & bad, 1.0).otherwise(0.1).alias(name) for name, _ in quality.RULES],
    )
    labels = at.select(F.col("id").alias("doc_id"), F.when(rare | ~bad, 1).otherwise(0).alias("quality"))
    found = {(r.stratum, r.rule): r.cutoff for r in quality.cutoffs(measured, labels, "stratum").collect()}
    assert found == {(s, name): 1.0 for s in ("rare", "common") for name, _ in quality.RULES}
