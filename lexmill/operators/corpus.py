"""Building a corpus: union, first-wins deduplication, repetition, split, statistics, cuts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import hashing
from lexmill.operators.order import running_sum


def _dedup_keys(records: DataFrame, rank: str, ordinal: str, key: Column) -> tuple[DataFrame, list]:
    """``records`` with ``_key``, and what rows are grouped by: rows without a key each stand alone, so they don't meet under null."""
    keyed = records.withColumn("_key", key)
    return keyed, ["_key", *[F.when(F.col("_key").isNull(), F.col(c)).alias(f"_{i}") for i, c in enumerate((rank, ordinal))]]


def first_wins(records: DataFrame, rank: str = "src_rank", ordinal: str = "ord", text: str = "text", key: Column | None = None) -> DataFrame:
    """Of texts with the same beginning and length the first by source and ordinal stays; rows without text all stay.

    Rank and ordinal identify a row. Where the text isn't needed any more, a ``key`` made of
    it before keeps it out of the shuffle. Spark limits groups before it deals them out, so
    a text copied very often sends one row from each task.
    """
    keyed, groups = _dedup_keys(records, rank, ordinal, hashing.dedup_key(F.col(text)) if key is None else key)
    return keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*groups).orderBy(rank, ordinal))).where("_r = 1").drop("_r", "_key")


def duplicates_by_source(records: DataFrame, source: str = "src", rank: str = "src_rank", ordinal: str = "ord", text: str = "text") -> DataFrame:
    """``(source, kept, duplicates)`` of ``first_wins``; copies are counted before they are dealt out."""
    narrow = records.select(source, rank, ordinal, hashing.dedup_key(F.col(text)).alias("_k"))
    keyed, groups = _dedup_keys(narrow, rank, ordinal, F.col("_k"))
    counted = keyed.groupBy(*groups, source).agg(F.count("*").alias("_n"), F.min(F.struct(rank, ordinal)).alias("_m"))
    first = F.min("_m").over(Window.partitionBy("_key", "_0", "_1"))  # one row for each source that has the text
    flagged = counted.withColumn("_f", (F.col("_m") == first).cast("long"))
    return flagged.groupBy(source).agg(F.sum("_f").alias("kept"), F.sum(F.col("_n") - F.col("_f")).alias("duplicates"))


def union(*sources: DataFrame) -> DataFrame:
    """Sources of different columns, one below the other."""
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def repeated(rows: DataFrame, times: Column | int, copy: str = "copy_no") -> DataFrame:
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.lit(times).cast("int") if isinstance(times, int) else times)))


def record_text(text: str = "text", messages: str = "messages") -> Column:
    return F.coalesce(F.col(text), F.array_join(F.transform(F.col(messages), lambda m: m["content"]), "\n"))


def split_text(text: str = "text", messages: str = "messages") -> Column:
    return F.coalesce(F.col(text), F.array_join(F.transform(F.col(messages), lambda m: m["content"]), " "))


def with_split(records: DataFrame, permille: int, text: str = "text", messages: str | None = None) -> DataFrame:
    """``split``: train or val by a hash of the content, so it survives any reordering."""
    key = split_text(text, messages) if messages else F.col(text)
    return records.withColumn("split", F.when(hashing.in_validation(key, permille), F.lit("val")).otherwise(F.lit("train")))


def source_stats(records: DataFrame, source: str = "src", chars: Column | None = None) -> DataFrame:
    """Documents and characters of each source, and of all (source null)."""
    chars = F.length("text") if chars is None else chars
    return records.withColumn("_c", chars).rollup(source).agg(F.count("*").alias("docs"), F.sum("_c").cast("long").alias("chars"))


def token_cut(records: DataFrame, limit: int, ordinal: str = "ord", tokens: str = "n_tokens", batch: int = 2000) -> DataFrame:
    """Whole batches of consecutive records up to the one with which ``limit`` tokens are reached; 0 keeps all."""
    if not limit:
        return records
    rows = records.withColumn("_batch", F.expr(f"{ordinal} div {batch}"))
    sums = rows.groupBy("_batch").agg(F.sum(tokens).alias("_t"))
    kept = running_sum(sums, "_batch", "_t", "_before").where(F.col("_before") < limit).select("_batch")
    return rows.join(kept, "_batch", "left_semi").drop("_batch")


def strided(rows: DataFrame, stride: int, ordinal: str = "ord") -> DataFrame:
    return rows.where(F.pmod(F.col(ordinal), F.lit(stride)) == 0)


def tokenizer_stride(n_bytes: int, most_mb: float) -> int:
    return max(1, int(n_bytes / (most_mb * 1e6)))


def flush_order(ordinal: str = "ord", is_chat: str = "is_chat", batch: int = 2000) -> list[Column]:
    """Inside each batch texts are written before chats."""
    return [F.expr(f"{ordinal} div {batch}"), F.col(is_chat), F.col(ordinal)]


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once, however often it is filtered on or used: as a one-row generator, which filters don't pass."""
    made = F.explode(F.array(value)).alias(name)
    return df.select(*[made if c == name else F.col(c) for c in df.columns], *([] if name in df.columns else [made]))


def survivors(rows: DataFrame, text: str, most: int, seed: int, id_col: str, clean: Callable[[DataFrame], DataFrame] | None = None, sample: int = 1000) -> DataFrame:
    """The first ``most`` rows whose ``text`` isn't null, in an order by seed.

    ``clean`` is the work that decides it, and is done for few rows more than are asked for:
    the order is a uniform hash, so rows under a threshold come first in it. About ``sample``
    rows tell how many survive, then the threshold rises until enough did; no row is cleaned
    twice. Without ``clean`` the rows are taken as they are.
    """
    if clean is None:
        found = rows.where(F.col(text).isNotNull())
    else:
        found = _cleaned_until(rows, text, most, hashing.uniform(seed, F.col(id_col)), clean, sample)
    chosen = found.select(F.col(id_col).alias("_id")).orderBy(hashing.order_key(seed, F.col("_id")), "_id").limit(most)
    if most <= 1_000_000:  # 8 MB of ids; beyond it the join is shuffled
        chosen = F.broadcast(chosen)
    return found.join(chosen, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")


def _cleaned_until(rows: DataFrame, text: str, most: int, place: Column, clean: Callable[[DataFrame], DataFrame], sample: int) -> DataFrame:
    from lexmill.storage import stage

    n = rows.count()
    low, high, got, parts = 0.0, min(1.0, max(sample, most) / max(n, 1)), 0, []
    while True:
        part = rows.where((place >= low) & (place < high) if high < 1 else place >= low)
        parts.append(stage(clean(part).where(F.col(text).isNotNull()), "survivors"))
        got += parts[-1].count()
        if got >= most or high >= 1:
            return union(*parts)
        # A fifth more than the rate so far asks for, and eight times as much as was tried at most, since rates of few rows vary.
        low, high = high, min(1.0, max(high * 1.1, min(high * 8, 1.2 * most * high / max(got, 1))))


def raw_counts(raw: DataFrame, cleaned: Column, source: str = "src") -> DataFrame:
    """``(source, raw, kept)``: rows read and rows that cleaning keeps."""
    return raw.groupBy(source).agg(F.count("*").alias("raw"), F.count(cleaned).alias("kept"))
