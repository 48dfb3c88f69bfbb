"""Scores of answers and of training logs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from lexmill.functions import unicode
from lexmill.functions.text import ARTICLES
from lexmill.operators.order import ranged
from lexmill.storage import stage


def answer_tokens(c: Column) -> Column:
    """Words that answers are compared by: lower case, decomposed, without marks and articles; null for null."""
    words = F.regexp_extract_all(unicode.unmarked(F.lower(c)), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(list(ARTICLES)))


@pandas_udf(T.DoubleType())
def token_f1(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """F1 over two word lists as multisets, in time linear in them; null where a list is."""

    def one(pred, ref) -> float | None:
        if pred is None or ref is None:
            return None
        if not len(pred) or not len(ref):
            return float(len(pred) == len(ref))
        common = sum((Counter(pred) & Counter(ref)).values())
        p, r = common / len(pred), common / len(ref)
        return 2 * p * r / (p + r) if common else 0.0

    for pred, ref in pairs:
        yield pd.Series([one(a, b) for a, b in zip(pred, ref, strict=True)], dtype="float64")


def qa_scores(scored: DataFrame) -> DataFrame:
    """``(n, exact_match, f1, ends_properly)`` of rows ``(em, f1, n_generated, max_new)``."""
    mean = lambda c: F.bround(F.coalesce(F.sum(c) / F.greatest(F.lit(1), F.count("*")), F.lit(0.0)), 4)
    return scored.agg(
        F.count("*").alias("n"), mean(F.col("em").cast("double")).alias("exact_match"), mean(F.col("f1")).alias("f1"),
        mean((F.col("n_generated") < F.col("max_new")).cast("double")).alias("ends_properly"),
    )


def qa_split(examples: DataFrame, end_id: int, max_new: int, context: int, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """``prompt`` before the first answer token and ``reference`` up to its end token; examples without room are left out."""
    first = F.greatest(F.lit(1), F.array_position(mask, F.lit(1).cast("tinyint"))).cast("int")
    cut = examples.withColumn("_f", first).withColumn("_tail", F.expr(f"slice({ids}, _f, greatest(0, size({ids}) - _f + 1))")).withColumn("_e", F.array_position("_tail", end_id).cast("int"))
    kept = cut.where((F.col("_e") > 0) & (F.col("_f") - 1 + max_new <= context))
    return kept.withColumn("prompt", F.expr(f"slice({ids}, 1, _f - 1)")).withColumn("reference", F.expr("slice(_tail, 1, _e - 1)")).drop("_f", "_tail", "_e")


def masked_mean_loss(rows: DataFrame, loss: str = "loss", label: str = "label") -> DataFrame:
    valid = F.col(label) != -1
    return rows.agg((F.sum(F.when(valid, F.col(loss)).otherwise(0.0)) / F.greatest(F.lit(1), F.sum(valid.cast("long")))).alias("mean_loss"), F.sum(valid.cast("long")).alias("n_labels"))


def perplexity(loss: Column, most: float | None = None) -> Column:
    return F.exp(F.least(loss, F.lit(most)) if most else loss)


# ---- training logs: (it, val_loss), (it, loss, tokens, t) -----------------------------------------------------------


def _over_parts(parts: DataFrame, *columns: Column) -> DataFrame:
    """A window over ranges: one row for each."""
    return F.broadcast(parts.select(F.col("_part").alias("_at"), *columns))


def running_best(evals: DataFrame, best: float = float("inf")) -> DataFrame:
    """``best_before``, ``improved`` (strictly below) and evaluations since the last improvement.

    Inside ranges of iterations, and over the ranges' minima and last improvements.
    """
    infinity = F.lit(float("inf"))
    cut = ranged(evals, "it", label="evals")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    least = _over_parts(
        cut.groupBy("_part").agg(F.min("val_loss").alias("_m"), F.count("*").alias("_n")),
        F.coalesce(F.min("_m").over(upto), infinity).alias("_m0"), F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_n0"),
    )
    within = Window.partitionBy("_part").orderBy("it")
    seen = cut.withColumn("_m1", F.coalesce(F.min("val_loss").over(within.rowsBetween(Window.unboundedPreceding, -1)), infinity)).withColumn("_k", F.row_number().over(within).cast("long"))
    seen = seen.join(least, F.col("_part") == F.col("_at")).withColumn("best_before", F.least("_m0", "_m1", F.lit(best))).withColumn("_i", F.col("_n0") + F.col("_k"))
    flagged = stage(seen.select(*evals.columns, "_part", "_i", "best_before", (F.col("val_loss") < F.col("best_before")).alias("improved")), "improved")
    hit = F.when(F.col("improved"), F.col("_i"))
    last = _over_parts(flagged.groupBy("_part").agg(F.max(hit).alias("_l")), F.max("_l").over(upto).alias("_l0"))
    out = flagged.withColumn("_l1", F.max(hit).over(within.rowsBetween(Window.unboundedPreceding, 0))).join(last, F.col("_part") == F.col("_at"))
    return out.withColumn("no_improve", F.col("_i") - F.coalesce("_l1", "_l0", F.lit(0))).select(*evals.columns, "best_before", "improved", "no_improve")


def early_stop(evals: DataFrame, patience: int, best: float = float("inf")) -> DataFrame:
    """``(stop_it)``: the first evaluation with ``patience`` in a row that didn't improve; null if none or off."""
    hit = (F.col("no_improve") >= patience) & F.lit(patience > 0)
    return running_best(evals, best).agg(F.min(F.when(hit, F.col("it"))).alias("stop_it"))


def last_of_each(log: DataFrame, key: str = "it", line: str = "line_no") -> DataFrame:
    """Of rows with the same iteration the last written."""
    return log.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(line).desc()))).where("_r = 1").drop("_r")


def summary(evals: DataFrame) -> DataFrame:
    """Least loss, its first iteration, the last loss and its distance."""
    out = evals.agg(F.min(F.struct("val_loss", "it")).alias("m"), F.max_by("val_loss", "it").alias("last_loss"))
    return out.select(F.col("m.val_loss").alias("min_loss"), F.col("m.it").alias("min_it"), "last_loss", (F.col("last_loss") - F.col("m.val_loss")).alias("gap"))


def throughput(log: DataFrame) -> DataFrame:
    """``tok_s``: tokens a second since the line before; a range's first line looks at the last one of those before it."""
    cut = ranged(log, "it", label="log")
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = _over_parts(cut.groupBy("_part").agg(F.max_by(F.struct("tokens", "t"), "it").alias("_e")), F.last("_e", True).over(upto).alias("_e0"))
    before = F.lag(F.struct("tokens", "t")).over(Window.partitionBy("_part").orderBy("it"))
    placed = cut.withColumn("_e1", before).join(ends, F.col("_part") == F.col("_at")).withColumn("_b", F.coalesce("_e1", "_e0"))
    dt = F.col("t") - F.col("_b.t")
    return placed.withColumn("tok_s", F.when(dt > 0, (F.col("tokens") - F.col("_b.tokens")) / dt)).select(*log.columns, "tok_s")


def curves(log: DataFrame) -> DataFrame:
    """``(kind, it, value, improved)`` of a mixed log."""
    return log.where(F.col("type").isin("train", "eval")).select(
        F.col("type").alias("kind"), "it", F.when(F.col("type") == "train", F.col("loss")).otherwise(F.col("val_loss")).alias("value"), F.when(F.col("type") == "eval", F.col("improved")).alias("improved")
    )


def checkpoints(files: DataFrame, keep: int, path: str = "path") -> DataFrame:
    """``(path, it, kept, latest)`` of checkpoint files by number; ``keep`` under 1 keeps all."""
    it = F.regexp_extract(path, r"ckpt_([0-9]+)\.pt$", 1)
    rows = files.withColumn("_n", it).where(F.col("_n") != "").select(path, F.col("_n").cast("long").alias("it"))
    newest = rows.select("it").orderBy(F.col("it").desc()).limit(max(1, keep)).agg(F.min("it").alias("_lo"), F.max("it").alias("_hi"))  # one row
    return rows.crossJoin(F.broadcast(newest)).select(path, "it", ((F.col("it") >= F.col("_lo")) | F.lit(keep <= 0)).alias("kept"), (F.col("it") == F.col("_hi")).alias("latest"))


def resume_best(saved: Column, sidecar: Column) -> Column:
    none = F.lit(float("inf"))
    return F.least(F.coalesce(saved, none), F.coalesce(sidecar, none))


def step_loss(rows: DataFrame) -> DataFrame:
    """Loss of each step over all its answer tokens, whatever micro-batches they came in."""
    return rows.groupBy("step").agg((F.sum("loss_sum") / F.greatest(F.lit(1), F.sum("n_answer"))).alias("loss"))
