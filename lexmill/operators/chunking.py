"""Files of any size cut into documents at paragraphs: lines, paragraphs, greedy chunks.

A file may lie in many splits. Lines are numbered over the whole file, paragraphs are sums over
the empty lines before, and where the next chunk begins follows for each paragraph from the
sum of lengths up to it. Which of these beginnings count is found by following them from the
file's first paragraph, in doubling steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.text import strip
from lexmill.operators.order import numbered, running_sum
from lexmill.storage import free, stage

#: Stand in for a replacement character that a text has itself, while ill-formed bytes are replaced and removed.
_OWN, _MARK, _OTHER = "\ufdd0\ufdd2", "\ufdd0", "\ufdd0\ufdd1"


def well_formed(c: Column) -> Column:
    """Without the bytes that aren't UTF-8."""
    guarded = F.replace(F.replace(c, F.lit(_MARK), F.lit(_OTHER)), F.lit("\ufffd"), F.lit(_OWN))
    valid = F.replace(F.make_valid_utf8(guarded), F.lit("\ufffd"), F.lit(""))
    return F.when(F.is_valid_utf8(c), c).otherwise(F.replace(F.replace(valid, F.lit(_OWN), F.lit("\ufffd")), F.lit(_OTHER), F.lit(_MARK)))


def lines(spark: SparkSession, paths: list[str], file: Column | None = None) -> DataFrame:
    """``(file, ord, line)`` of text files; ``file`` makes one file of several, in the order of their names."""
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    found = spark.read.text(paths).select((F.col("_metadata.file_path") if file is None else file).alias("file"), at.alias("at"), well_formed(F.col("value")).alias("line"))
    return numbered(found, F.col("at"), by=["file"]).select("file", "ord", "line")


def paragraphs(lines_: DataFrame) -> DataFrame:
    """``(file, ord, text)``: lines between empty ones, without white space at the ends; blank ones are left out."""
    part = running_sum(lines_, "ord", F.when(F.col("line") == "", 1).otherwise(0), "part", by=["file"]).where("line <> ''")
    gathered = part.groupBy("file", "part").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    text = strip(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return numbered(gathered.select("file", "part", text.alias("text")).where("text <> ''"), F.col("part"), by=["file"]).select("file", "ord", "text")


def followed(pointers: DataFrame, by: list[str], at: str = "ord", to: str = "to") -> DataFrame:
    """The places reached from each group's place 0 by following ``at`` to ``to``; a null ``to`` ends.

    The set of places reached doubles with each step, as the pointers are joined to themselves.
    """
    jump = stage(pointers.select(*by, F.col(at).alias("_at"), F.col(to).alias("_to")), "pointers")
    reached = stage(jump.where("_at = 0").select(*by, "_at"), "reached")
    while True:
        hit = reached.join(jump.where("_to is not null"), [*by, "_at"]).select(*by, F.col("_to").alias("_at"))
        grown = stage(reached.unionByName(hit).distinct(), "reached")
        if grown.count() == reached.count():
            free(jump, grown)
            return reached.withColumnRenamed("_at", at)
        second = jump.select(*by, F.col("_at").alias("_to"), F.col("_to").alias("_next"))
        further = stage(jump.join(second, [*by, "_to"], "left").select(*by, "_at", F.col("_next").alias("_to")), "pointers")
        free(jump, reached)
        jump, reached = further, grown


def chunked(paragraphs_: DataFrame, size: int = 4000, least_tail: int = 200) -> DataFrame:
    """``(file, chunk_no, text)``: paragraphs gathered until ``size`` characters are reached; a rest shorter than ``least_tail`` is dropped."""
    whole = stage(paragraphs_.withColumn("n", F.length("text").cast("long")), "paragraphs")
    placed = stage(running_sum(whole.select("file", "ord", "n"), "ord", "n", "before", by=["file"]), "paragraph-sizes")
    # A chunk that begins with a paragraph ends in the one that holds the size-th character from there on, found in buckets of characters.
    bucket = lambda c: ((c - F.pmod(c, F.lit(size))) / size).cast("long")
    asked = placed.select("file", "ord", (F.col("before") + size - 1).alias("_c")).withColumn("_b", bucket(F.col("_c")))
    held = placed.select("file", F.col("ord").alias("_end"), "before", "n").withColumn("_b", F.explode(F.sequence(bucket(F.col("before")), bucket(F.col("before") + F.col("n") - 1))))
    ends = asked.join(held, ["file", "_b"]).where("_c >= before and _c < before + n").select("file", "ord", (F.col("_end") + 1).alias("to"))
    last = placed.groupBy("file").agg((F.max("ord") + 1).alias("_n"))
    pointers = placed.select("file", "ord").join(ends, ["file", "ord"], "left").join(last, "file").select("file", "ord", F.when(F.col("to") < F.col("_n"), F.col("to")).alias("to"))
    begins = followed(pointers, ["file"]).withColumn("_begins", F.lit(1))
    marked = placed.join(begins, ["file", "ord"], "left")
    numbers = running_sum(marked, "ord", F.coalesce("_begins", F.lit(0)), "_k", by=["file"]).select("file", "ord", (F.col("_k") + F.coalesce("_begins", F.lit(0)) - 1).cast("int").alias("chunk_no"))
    gathered = whole.join(numbers, ["file", "ord"]).groupBy("file", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"), F.sum("n").alias("n"))
    return gathered.where(F.col("n") >= min(size, least_tail)).select("file", "chunk_no", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
