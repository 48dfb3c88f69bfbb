"""Arithmetic on model and training settings, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_up(x: Column, m: int) -> Column:
    return F.floor((x + m - 1) / m).cast("long") * m


def ffn_width(d_model: Column) -> Column:
    return round_up(F.floor(F.lit(8 / 3) * d_model).cast("long"), 64)


def parameters(vocab: Column, layers: Column, d: Column, heads: Column, kv_heads: Column, ffn: Column, tied: Column, qk_norm: Column) -> Column:
    """Exact count: embeddings, attention with grouped keys, gated feed-forward, norms."""
    head = (d / heads).cast("long")
    attention = d * d * 2 + d * kv_heads * head * 2 + F.when(qk_norm, 2 * head).otherwise(0)
    block = attention + 3 * d * ffn + 2 * d
    return (vocab * d * F.when(tied, 1).otherwise(2) + layers * block + d).cast("long")


def valid(d: Column, heads: Column, kv_heads: Column) -> Column:
    return (d % heads == 0) & (heads % kv_heads == 0) & ((d / heads).cast("long") % 2 == 0)


def size_name(n: Column) -> Column:
    return (
        F.when(n >= 10**9, F.format_string("%.1fB", n / 1e9))
        .when(n >= 10**6, F.concat(F.bround(n / 1e6, 0).cast("long").cast("string"), F.lit("M")))
        .otherwise(F.concat(F.bround(n / 1e3, 0).cast("long").cast("string"), F.lit("K")))
    )


def token_dtype(vocab: Column) -> Column:
    return F.when(vocab <= 65_535, F.lit("uint16")).otherwise(F.lit("uint32"))


def learning_rate(it: Column, lr: float, least: float, warmup: int, schedule: str, decay: float, most: int) -> Column:
    warm = lr * (it + 1) / warmup if warmup else F.lit(lr)
    if schedule == "wsd":
        start = int(most * (1 - decay))
        rest = F.when(it < start, F.lit(lr)).otherwise(lr + (least - lr) * F.least(F.lit(1.0), (it - start) / max(1, most - start)))
    else:
        share = (it - warmup) / max(1, most - warmup)
        rest = F.when(it >= most, F.lit(least)).otherwise(least + 0.5 * (1 + F.cos(F.lit(math.pi) * share)) * (lr - least))
    return F.when(it < warmup, warm).otherwise(rest)


def plan(batch: Column, accum: Column, world: Column, length: Column, iters: Column, tokens: Column) -> tuple[Column, Column, Column]:
    """Tokens an iteration, tokens in all, and epochs of them."""
    each = batch * accum * world * length
    return each, each * iters, each * iters / tokens


def iterations_per_epoch(n_blocks: Column, batch: Column, accum: Column, world: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_blocks / (batch * accum * world)).cast("long"))


def epoch_of(step: Column, batch: Column, world: Column, n_blocks: Column) -> Column:
    """How many epochs are behind a rank's step, with fractions."""
    return step * batch * world / F.greatest(F.lit(1), n_blocks)
