"""The corpus pipeline: language ID, quality rules, near-duplicates, mixing, encoding.

Each stage takes all rows that the stage before kept, written as Parquet and read again. All
but the last return the columns of ``documents``, in their order, and further ones that the
table has, whatever their names. ``mixture`` adds the place of each row in the mix, since files
of a table have no order; ``encoding`` passes it on.

Defined results, for all stages: an empty table stays empty; a null id is an id like others,
but its rows are never learned from and never near-duplicates; texts may have any length. What
happens to null and empty texts and to repeated rows each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import storage
from lexmill.llm import bpe, langid, mix, neardup, quality
from lexmill.llm.queries import table, vocabulary

#: Percent of shared shingles from which documents are near-duplicates.
NEAR = 80


#: The columns that stages work on; all others are carried in one struct, so that no name of theirs matters.
OWN = ("doc_id", "text", "lang", "source")
#: Where a row stands in the mix.
PLACE = "mix_slot"


def _alone(stage):
    """What a stage has staged for itself is removed when the next begins: its result is written by then."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        storage.importable(spark)
        storage.sweep("pipeline stage")
        others = [c for c in docs.columns if c not in OWN]
        carried = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
        with storage.owned_by("pipeline stage"):
            out = stage(spark, docs.select(*OWN, carried.alias("carried")), sf_dir)
        if "carried" not in out.columns:
            return out
        made = [c for c in out.columns if c not in OWN and c != "carried"]  # a column that had this name before is replaced
        return out.select(*[F.col(c) if c in OWN else F.col("carried").getField(c).alias(c) for c in docs.columns if c not in made], *made)

    run.__name__ = stage.__name__
    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null and empty texts, texts without letters. Each row is judged for itself."""
    pieces = vocabulary("piece_bpe_32k.model")
    model = langid.train(docs.where(~langid.held_out()), pieces)
    return langid.identified(docs, model, pieces)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a rule go; those with null or empty texts fail the base. Each row is judged for itself."""
    judged = quality.judge(docs.select(*OWN), table(spark, sf_dir, "labels")).where("kept")
    kept = judged.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text", "lang") == F.col("_hash")), "left_semi")


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Texts without words are nobody's duplicates. Of rows with the same id and text one stays.
    """
    gone = neardup.near_duplicates(docs, threshold=NEAR).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = storage.stage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").select("doc_id"), "repeated-ids")
    # Only rows whose id is repeated are compared whole.
    once = left.join(again, "doc_id", "left_anti").select(*docs.columns)
    return once.unionByName(left.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix comes to its beginning, with its place in the mix's order.

    Texts without words are in no mix. Rows with the same id, text and source come as often as
    the one of them that comes most often.
    """
    slots = mix.mix(docs).groupBy("doc_id", "row_hash").agg(F.max("slots").alias("_slots"))
    slots = slots.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "_slots").where(F.size("_slots") > 0)
    both = docs.join(slots, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text", "source") == F.col("_hash")))
    return both.select(*docs.columns, F.explode("_slots").alias(PLACE))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, mix_slot, n_tokens, token_ids)`` of each row of the mix; a null text has no tokens. Without a mix before it, places are null.

    All ids are decoded again; where that doesn't give the row's text the stage fails.
    """
    place = F.col("carried").getField(PLACE) if PLACE in docs.schema["carried"].dataType.names else F.lit(None).cast("long")
    return bpe.encode(docs.withColumn(PLACE, place), vocabulary("byte_bpe_multi_50k.tiktoken"), decode=False, keep=(PLACE,), check=True)


STAGES = [(f.__name__, _alone(f)) for f in (language, rules, duplicates, mixture, encoding)]

#: SQL expresses neither the trained models nor the hashes; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        path = storage.new_path(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
