"""Sources as DataFrames with explicit schemas, and sinks."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions import text as tx
from lexmill.operators import chunking, corpus, sft

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
RECORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("messages", MESSAGES), T.StructField("src", T.StringType()), T.StructField("ord", T.LongType())])
#: Names in users' own files, the first that is filled counts.
OWN_QUESTIONS, OWN_ANSWERS = ("question", "instruction", "prompt"), ("answer", "response", "output")
ANSWERS = T.StructType([T.StructField("text", T.ArrayType(T.StringType())), T.StructField("answer_start", T.ArrayType(T.IntegerType()))])


def _first(raw: DataFrame, clean: Callable[[DataFrame], DataFrame], column: str, most: int | None, seed: int, id_col: str) -> DataFrame:
    return corpus.survivors(raw, column, most, seed, id_col, clean) if most else clean(raw).where(F.col(column).isNotNull())


def articles(raw: DataFrame, most: int | None, seed: int, id_col: str = "id", text: str = "text") -> DataFrame:
    """Encyclopaedia articles, cleaned; the first ``most`` survivors in an order by seed."""
    return _first(raw, lambda df: corpus.computed(df, text, tx.article(tx.judged_lines(F.col(text)))), text, most, seed, id_col)


def web(raw: DataFrame, most: int | None, seed: int, id_col: str = "id", text: str = "text") -> DataFrame:
    return _first(raw, lambda df: corpus.computed(df, text, tx.web_page(F.col(text))), text, most, seed, id_col)


def local_files(spark: SparkSession, paths: list[str], chunk_chars: int = 4000) -> DataFrame:
    """``(path, chunk_no, text)`` of text files, cut at paragraphs; files of any size, read in splits. Ill-formed bytes are left out."""
    return chunking.chunked(chunking.paragraphs(chunking.lines(spark, paths)), chunk_chars).withColumnRenamed("file", "path")


def dialogues(raw: DataFrame, most: int | None, seed: int, id_col: str = "id", text: str = "text") -> DataFrame:
    return _first(raw, lambda df: corpus.computed(df, "messages", tx.dialogue(F.col(text))), "messages", most, seed, id_col)


def extractive_qa(rows: DataFrame, prefix: str = "Contexte : ", middle: str = "\n\nQuestion : ") -> DataFrame:
    """Questions on a context as conversations; the context is cut to a window that holds the answer."""
    first = rows.withColumn("_a", F.try_element_at("answers.text", F.lit(1))).withColumn("_at", F.try_element_at("answers.answer_start", F.lit(1)))
    kept = first.where(tx.strip(F.col("_a")) != "").withColumn("_w", tx.qa_window("context", "_at", "length(_a)")).where(F.contains("_w", tx.strip(F.col("_a"))))
    question = F.concat(F.lit(prefix), "_w", F.lit(middle), "question")
    return kept.withColumn("messages", sft.pair(question, tx.ends_sentence(tx.strip(F.col("_a"))))).drop("_a", "_at", "_w")


def instructions(rows: DataFrame, most: int | None, seed: int, id_col: str = "id") -> DataFrame:
    kept = sft.instructions(rows)
    kept = kept.withColumn("messages", sft.pair(F.col("question"), F.col("answer")))
    return corpus.survivors(kept, "messages", most, seed, id_col) if most else kept


def user_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """``messages`` of a JSON-lines file: given as such, or made of a question and an answer under any usual name.

    Where a line has several of the names, a question goes before an instruction, an answer before an output.
    """
    names = [*OWN_QUESTIONS, *OWN_ANSWERS]
    schema = T.StructType([T.StructField("messages", MESSAGES), *[T.StructField(n, T.StringType()) for n in names]])
    rows = spark.read.schema(schema).json(path)
    q, a = tx.first_filled(*map(F.col, OWN_QUESTIONS)), tx.first_filled(*map(F.col, OWN_ANSWERS))
    made = F.when((q != "") & (a != ""), sft.pair(q, a))
    return rows.select(F.coalesce("messages", made).alias("messages")).where("messages is not null")


def records(spark: SparkSession, path: str, stride: int = 1) -> DataFrame:
    """A written corpus; with a stride every so-manieth record by its ordinal."""
    rows = spark.read.schema(RECORD).json(path)
    return corpus.strided(rows, stride) if stride > 1 else rows


def guarded(name: str, build: Callable[[], DataFrame], empty: DataFrame) -> DataFrame:
    """A source that fails is reported and left out. It is written here, since a lazy frame fails only later."""
    from lexmill.storage import stage

    try:
        return stage(build(), f"source-{name}")
    except Exception as e:  # any failure of a foreign source  # noqa: BLE001
        logging.getLogger(__name__).warning("source %s is left out: %s", name, e)
        return empty


ERRORS = "source string, part int, error string, kept long"


def guarded_parts(spark: SparkSession, name: str, parts: Iterable[Callable[[], DataFrame]], empty: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A source that comes in parts: those before a failure stay, and the failure is a row of the second table.

    Each part is written for itself before the next is asked for, so what a later one loses
    isn't theirs. Parts after the first failure aren't tried, as the source has ended there.
    """
    from lexmill.storage import stage

    kept, failed, n = [], [], 0
    for i, build in enumerate(parts):
        try:
            kept.append(stage(build(), f"source-{name}"))
            n += kept[-1].count()
        except Exception as e:  # any failure of a foreign source  # noqa: BLE001
            logging.getLogger(__name__).warning("source %s ends at part %s, %s rows stay: %s", name, i, n, e)
            failed.append((name, i, f"{type(e).__name__}: {e}"[:500], n))
            break
    return corpus.union(*kept) if kept else empty, spark.createDataFrame(failed, ERRORS)


def in_parts(rows: Callable[[], DataFrame], ordinal: str, size: int, n: int) -> list[Callable[[], DataFrame]]:
    """A source of ``n`` rows by ranges of its ordinal, ``size`` rows a part."""
    return [lambda a=a: rows().where((F.col(ordinal) >= a) & (F.col(ordinal) < a + size)) for a in range(0, n, size)]


def write_corpus(rows: DataFrame, path: str) -> None:
    """JSON lines by source, with the ordinal that readers order by."""
    rows.write.partitionBy("src").json(path)


def write_examples(examples: DataFrame, path: str, ordinal: str = "ord", ids: str = "ids", mask: str = "mask") -> DataFrame:
    """Ragged examples with offsets, and ``(split, n_examples, n_tokens, n_answer_tokens)``."""
    from lexmill.operators.order import running_sum

    running_sum(examples, ordinal, F.size(ids), "offset", by=["split"]).write.partitionBy("split").parquet(path)
    return examples.groupBy("split").agg(
        F.count("*").alias("n_examples"), F.sum(F.size(ids)).cast("long").alias("n_tokens"), F.sum(F.aggregate(mask, F.lit(0), lambda n, x: n + x.cast("int"))).cast("long").alias("n_answer_tokens")
    )


#: Tokens of a stream that lie in one folder of it.
SHELF = 1 << 26


def write_stream(docs: DataFrame, path: str, ids: str = "ids", ordinal: str = "ord", shelf: int = SHELF, size: str | None = None) -> None:
    """Token streams by split, each document with the position at which it begins, in shelves by position; and an index without the ids.

    ``size`` names a column that has the number of ids without making them.
    """
    from lexmill.operators.order import running_sum
    from lexmill.storage import stage

    n = (F.size(ids) if size is None else F.col(size)).cast("long")
    sized = stage(docs.select("split", ordinal, n.alias("n")), "stream-sizes")
    placed = running_sum(sized, ordinal, "n", "offset", by=["split"]).withColumn("shelf", F.expr(f"offset div {shelf}"))
    placed.write.parquet(f"{path}/_index")
    index = docs.sparkSession.read.schema(placed.schema).parquet(f"{path}/_index")
    rows = docs.select("split", ordinal, F.col(ids).alias("ids")).join(index.select("split", ordinal, "offset", "shelf"), ["split", ordinal])
    rows.write.partitionBy("split", "shelf").mode("append").parquet(path)


def stream_index(spark: SparkSession, path: str) -> DataFrame:
    """``(split, ordinal, n, offset, shelf)`` of each document of a stream, without reading ids."""
    return spark.read.parquet(f"{path}/_index")


def read_shelves(spark: SparkSession, path: str, split: str, shelves: list[int]) -> DataFrame:
    """The documents on some shelves; folders of others aren't scanned."""
    return spark.read.parquet(path).where((F.col("split") == split) & F.col("shelf").isin(shelves))


def _java(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def write_manifest(values: dict, spark: SparkSession, path: str) -> None:
    """One JSON object, put in place by a rename over what was there: at any time the old or the new one is whole."""
    jvm = spark._jvm
    target, fs = _java(spark, path)
    made = jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    out = fs.create(made, True)
    out.write(bytearray(json.dumps(values, ensure_ascii=False, indent=2).encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(fs.makeQualified(made), fs.makeQualified(target), options)


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """What ``write_manifest`` put there, or None."""
    if not exists(spark, path):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def append_log(rows: DataFrame, path: str) -> int:
    """Further lines of a run's log, in the order they have; returns the number of the append.

    An append is a folder of its own, so none is rewritten. It is written aside and put in
    place by a rename to the next free number, which only one of several writers gets: what
    fails midway is never seen, and commits have an order.
    """
    spark = rows.sparkSession
    aside = f"{path}/_{uuid.uuid4().hex}"
    rows.drop("line_no").withColumn(_PLACE, F.monotonically_increasing_id()).write.json(aside)
    source, fs = _java(spark, aside)
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        taken = [s.getPath().getName() for s in fs.listStatus(source.getParent())]
        number = 1 + max((int(t.partition("=")[2]) for t in taken if t.startswith(f"{_APPEND}=")), default=-1)
        target = f"{path}/{_APPEND}={number}"
        try:
            files.rename(fs.makeQualified(source), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(target)), none)
            return number
        except Py4JJavaError:
            if not exists(spark, target):  # it failed for another reason than that another writer was first
                raise


#: Where a line stands: the append it came with, and its place there.
_APPEND, _PLACE = "append", "place"

LOG = T.StructType(
    [
        *[T.StructField(n, k) for n, k in (("type", T.StringType()), ("it", T.LongType()), ("loss", T.DoubleType()), ("val_loss", T.DoubleType()), ("best", T.DoubleType()), ("improved", T.BooleanType()))],
        *[T.StructField(n, k) for n, k in (("lr", T.DoubleType()), ("gnorm", T.DoubleType()), ("tok_s", T.DoubleType()), ("tokens", T.LongType()), ("t", T.DoubleType()), ("line_no", T.LongType()))],
    ]
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The log with ``line_no``: 0, 1, ... by commit, and inside an append by the order it was given in."""
    from lexmill.operators.order import numbered

    written = T.StructType([*[f for f in LOG if f.name != "line_no"], T.StructField(_PLACE, T.LongType()), T.StructField(_APPEND, T.LongType())])
    rows = spark.read.schema(written).json(path)
    return numbered(rows, F.col(_APPEND), F.col(_PLACE), out="line_no").select(*LOG.names)


def read_stream(spark: SparkSession, path: str, length: int) -> DataFrame:
    """What ``write_stream`` wrote, unless a split is too small to cut blocks of ``length`` from."""
    rows = spark.read.parquet(path)
    sizes = {r["split"]: r["n"] for r in rows.groupBy("split").agg(F.sum(F.size("ids")).alias("n")).collect()}  # a row for each split
    if sizes.get("train", 0) // length - 1 < 1:
        raise ValueError(f"{sizes.get('train', 0)} training tokens are too few for blocks of {length}")
    if sizes.get("val", 0) < length + 1:
        raise ValueError(f"{sizes.get('val', 0)} validation tokens are too few for blocks of {length}: hold out more documents")
    return rows


def read_examples(spark: SparkSession, path: str, split: str, batch: int = 1, world: int = 1) -> DataFrame:
    """One split of what ``write_examples`` wrote, unless training examples don't fill a batch on each rank."""
    rows = spark.read.parquet(path).where(F.col("split") == split)
    if split == "train" and (n := rows.count()) // world < batch:
        raise ValueError(f"{n} training examples are too few for batches of {batch} on {world} ranks")
    return rows


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage has run: its manifest is there."""
    target, fs = _java(spark, path)
    return fs.exists(target)


def verified(docs: DataFrame, padded_vocab: int, ids: str = "ids", least_val: int = 100_000) -> DataFrame:
    """``docs``, unless it is empty or an id doesn't fit the vocabulary; few validation tokens are warned about."""
    held = F.sum(F.when(F.col("split") == "val", F.size(ids)).otherwise(0)) if "split" in docs.columns else F.lit(least_val)
    most, val = docs.agg(F.max(F.array_max(ids)), held).first()
    if most is None:
        raise ValueError("the corpus is empty")
    if most >= padded_vocab:
        raise ValueError(f"token id {most} doesn't fit a vocabulary of {padded_vocab}")
    if val < least_val:
        logging.getLogger(__name__).warning("only %s validation tokens: hold out more documents", val)
    return docs


def compatible(data_vocab: int, model_vocab: int, longest: int, context: int) -> None:
    if data_vocab != model_vocab:
        raise ValueError(f"the data were made for a vocabulary of {data_vocab}, the model has {model_vocab}")
    if longest > context:
        raise ValueError(f"sequences of {longest} tokens exceed the context of {context}")
