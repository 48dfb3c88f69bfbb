"""Filters on next-token scores, one row a candidate: ``(step, token_id, logit)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import hashing



def _step():
    return Window.partitionBy("step")


@dataclass(frozen=True)
class Sampling:
    temperature: float = 0.7
    top_k: int = 40
    top_p: float = 0.9
    min_p: float = 0.0
    repetition_penalty: float = 1.1
    no_repeat_ngram: int = 3
    valid_vocab: int | None = None
    forbidden: tuple[int, ...] = ()
    window: int = 256


def masked(logits: DataFrame, valid_vocab: int | None = None, forbidden: tuple[int, ...] = ()) -> DataFrame:
    out = logits if valid_vocab is None else logits.where(F.col("token_id") < valid_vocab)
    return out.where(~F.col("token_id").isin(*forbidden)) if forbidden else out


def penalised(logits: DataFrame, history: DataFrame, penalty: float, window: int = 256) -> DataFrame:
    """``history``: ``(step, generated ARRAY)``. Tokens generated lately lose score."""
    recent = history.select("step", F.explode(F.array_distinct(F.slice("generated", F.greatest(F.lit(1), F.size("generated") - window + 1), F.lit(window)))).alias("token_id"), F.lit(True).alias("_seen"))
    lower = F.when(F.col("logit") > 0, F.col("logit") / penalty).otherwise(F.col("logit") * penalty)
    return logits.join(recent, ["step", "token_id"], "left").withColumn("logit", F.when(F.col("_seen"), lower).otherwise(F.col("logit"))).drop("_seen")


def banned(generated: Column, n: int) -> Column:
    """Tokens that would complete an n-gram of the history once more."""
    if n < 2:
        return F.array().cast("array<int>")
    size = F.size(generated)
    tail = F.slice(generated, F.greatest(F.lit(1), size - n + 2), F.lit(n - 1))
    starts = F.when(size >= n, F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1))).otherwise(F.array().cast("array<int>"))
    hits = F.filter(starts, lambda i: F.slice(generated, i, F.lit(n - 1)) == tail)
    return F.array_sort(F.array_distinct(F.transform(hits, lambda i: F.element_at(generated, i + n - 1))))


def without_repeats(logits: DataFrame, history: DataFrame, n: int) -> DataFrame:
    bans = history.select("step", F.explode(banned(F.col("generated"), n)).alias("token_id"))
    return logits.join(bans, ["step", "token_id"], "left_anti")


def best(logits: DataFrame) -> DataFrame:
    return logits.groupBy("step").agg(F.max(F.struct(F.col("logit"), (-F.col("token_id")).alias("i"))).alias("m")).select("step", (-F.col("m.i")).alias("token_id"))


def top_k(logits: DataFrame, k: int) -> DataFrame:
    """Ties at the threshold survive; 0 is off."""
    if k <= 0:
        return logits
    return logits.withColumn("_r", F.rank().over(_step().orderBy(F.col("logit").desc()))).where(F.col("_r") <= k).drop("_r")


def softmax(logits: DataFrame, temperature: float = 1.0) -> DataFrame:
    e = logits.withColumn("_e", F.exp((F.col("logit") - F.max("logit").over(_step())) / temperature))
    return e.withColumn("p", F.col("_e") / F.sum("_e").over(_step())).drop("_e")


def min_p(probs: DataFrame, least: float) -> DataFrame:
    return probs.withColumn("_m", F.max("p").over(_step())).where(F.col("p") >= least * F.col("_m")).drop("_m") if least > 0 else probs


def top_p(probs: DataFrame, mass: float) -> DataFrame:
    """The most probable tokens until what comes before one exceeds ``mass`` of all."""
    if mass >= 1:
        return probs
    before = F.sum("p").over(_step().orderBy(F.col("p").desc(), "token_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("p")
    return probs.withColumn("_b", before).withColumn("_t", F.sum("p").over(_step())).where(F.col("_b") <= mass * F.col("_t")).drop("_b", "_t")


def distribution(logits: DataFrame, history: DataFrame, cfg: Sampling) -> DataFrame:
    """All filters in their order, then probabilities that sum to 1."""
    at = masked(logits, cfg.valid_vocab, cfg.forbidden)
    if cfg.repetition_penalty != 1:
        at = penalised(at, history, cfg.repetition_penalty, cfg.window)
    at = without_repeats(at, history, cfg.no_repeat_ngram) if cfg.no_repeat_ngram > 1 else at
    if cfg.temperature <= 0:
        return best(at).withColumn("p", F.lit(1.0))
    at = at.withColumn("logit", F.col("logit") / cfg.temperature)
    at = top_p(min_p(softmax(top_k(at, cfg.top_k)), cfg.min_p), cfg.top_p)
    return at.withColumn("p", F.col("p") / F.sum("p").over(_step())).select("step", "token_id", "p")


def draw(probs: DataFrame, seed: int) -> DataFrame:
    """One token a step, by inverting the cumulative distribution at a number hashed from the seed."""
    c = probs.withColumn("_c", F.sum("p").over(_step().orderBy("token_id").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_t", F.sum("p").over(_step()))
    hit = c.where(F.col("_c") >= hashing.uniform(seed, F.col("step")) * F.col("_t"))
    return hit.groupBy("step").agg(F.min("token_id").alias("token_id"))


def truncated_history(turns: DataFrame, context: int, max_new: int, conv: str = "conv_id", turn: str = "turn", n: str = "n_tokens", prompt: int = 1, least_answer: int = 16) -> DataFrame:
    """The turns that stay: a leading system turn, and the longest end of the talk that fits.

    A shortened talk doesn't begin with an assistant. If no end fits, the system turn stays
    alone, or without one the last turn unless it is an assistant's; of what is still too long
    to leave ``least_answer`` tokens, the end is kept (``n_kept`` of each turn's tokens).
    Groups are single talks.
    """
    room = context - min(max_new, context // 2) - prompt
    own = Window.partitionBy(conv)
    marked = turns.withColumn("_sys", (F.col("role") == "system") & (F.col(turn) == F.min(turn).over(own)))
    sized = marked.withColumn("_head", F.sum(F.when(F.col("_sys"), F.col(n)).otherwise(0)).over(own)).withColumn("_any", F.max(F.col("_sys").cast("int")).over(own))
    back = own.orderBy(F.col(turn).desc()).rowsBetween(Window.unboundedPreceding, 0)
    tail = sized.withColumn("_tail", F.sum(F.when(F.col("_sys"), 0).otherwise(F.col(n))).over(back))
    opens = (F.col(turn) == F.min(F.when(~F.col("_sys"), F.col(turn))).over(own)) | (F.col("role") != "assistant")
    fits = tail.withColumn("_ok", ~F.col("_sys") & opens & (F.col("_head") + F.col("_tail") <= room))
    last = F.max(turn).over(own)
    alone = F.when((F.col("_any") == 0) & (F.col(turn) == last) & (F.col("role") != "assistant"), F.col(turn))
    first = fits.withColumn("_first", F.min(F.when(F.col("_ok"), F.col(turn))).over(own)).withColumn("_alone", F.max(alone).over(own))
    stay = first.where(F.col("_sys") | (F.col(turn) >= F.coalesce("_first", "_alone")))
    later = F.sum(n).over(back) - F.col(n)
    cut = F.greatest(F.lit(0), F.least(F.col(n), F.lit(room) - F.col("_later")))
    whole = F.col("_total") + prompt + least_answer <= context
    return stay.withColumn("_later", later).withColumn("_total", F.sum(n).over(own)).withColumn("n_kept", F.when(whole, F.col(n)).otherwise(cut)).select(*turns.columns, "n_kept")
