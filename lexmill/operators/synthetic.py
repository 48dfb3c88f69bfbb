"""Generated question-answer families. Facts and wording come in as tables; numbers from hashes of the seed."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import hashing


def _pick(n: int, *parts) -> Column:
    return F.floor(hashing.uniform(*parts) * n).cast("long")


#: Kinds of sums with their shares, greatest operands, and how they are said and written.
SUMS = (("+", 2, 50, "plus", "+"), ("-", 1, 60, "moins", "-"), ("*", 1, 10, "fois", "×"))
#: Share of questions in words, and their forms.
SPOKEN, FORMS = 0.6, ("Combien font {} ?", "Combien fait {} ?", "{} ?")
#: Fixed value: letters before which an article is elided.
VOWELS = "aeiouhéèêàâîïôûAEIOUH"


def _chosen(op: Column, values: dict) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(op == name, F.lit(value)).otherwise(out)
    return out


def arithmetic(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """``(i, question, answer, a, b, op, value)``: sums twice as often as differences and products; differences are never negative.

    Most questions are in words, in one of three forms, and answered in words; the others are
    written with signs and answered by an equation.
    """
    i = F.col("i")
    ops = [op for op, share, *_ in SUMS for _ in range(share)]
    top = _chosen(F.col("op"), {op: most + 1 for op, _, most, *_ in SUMS})
    drawn = spark.range(n).select(F.col("id").alias("i")).withColumn("op", F.element_at(F.array(*map(F.lit, ops)), (_pick(len(ops), seed, "op", i) + 1).cast("int")))
    drawn = drawn.withColumn("_x", F.floor(hashing.uniform(seed, "a", i) * top).cast("long")).withColumn("_y", F.floor(hashing.uniform(seed, "b", i) * top).cast("long"))
    drawn = drawn.withColumn("a", F.when(F.col("op") == "-", F.greatest("_x", "_y")).otherwise(F.col("_x"))).withColumn("b", F.when(F.col("op") == "-", F.least("_x", "_y")).otherwise(F.col("_y")))
    value = F.when(F.col("op") == "+", F.col("a") + F.col("b")).when(F.col("op") == "-", F.col("a") - F.col("b")).otherwise(F.col("a") * F.col("b"))
    term = lambda how: F.concat(F.col("a"), F.lit(" "), _chosen(F.col("op"), how), F.lit(" "), F.col("b"))
    said, written = term({op: word for op, _, _, word, _ in SUMS}), term({op: sign for op, *_, sign in SUMS})
    form = F.element_at(F.array(*map(F.lit, FORMS)), (_pick(len(FORMS), seed, "wording", i) + 1).cast("int"))
    spoken = hashing.uniform(seed, "form", i) < SPOKEN
    verb = F.when(F.col("value") == 1, F.lit(" fait ")).otherwise(F.lit(" font "))
    out = drawn.withColumn("value", value)
    out = out.withColumn("question", F.when(spoken, F.replace(form, F.lit("{}"), said)).otherwise(F.concat(F.lit("Combien font "), written, F.lit(" ?"))))
    out = out.withColumn("answer", F.when(spoken, F.concat(said, verb, F.col("value"), F.lit("."))).otherwise(F.concat(written, F.lit(" = "), F.col("value"), F.lit("."))))
    return out.select("i", "question", "answer", "a", "b", "op", "value")


def calendar(spark: SparkSession, days: list[str], months: list[str]) -> DataFrame:
    """Next and previous day and month, the number of each month, and both lists."""
    def around(names, kind):
        rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, name string")
        other = rows.select(F.col("i").alias("j"), F.col("name").alias("other"))
        step = lambda d, w: rows.withColumn("j", F.pmod(F.col("i") + d, F.lit(len(names)))).join(other, "j").select(F.concat(F.lit(f"Quel {kind} vient {w} {'le ' if kind == 'jour' else ''}"), "name", F.lit(" ?")).alias("question"), F.concat(F.col("other"), F.lit(".")).alias("answer"))
        return step(1, "après").unionByName(step(-1, "avant"))

    of = F.when(F.col("name").rlike(f"^[{VOWELS}]"), F.lit("d'")).otherwise(F.lit("de "))
    numbers = spark.createDataFrame([(i + 1, n) for i, n in enumerate(months)], "i long, name string").select(F.concat(F.lit("Quel est le numéro du mois "), of, "name", F.lit(" ?")).alias("question"), F.concat(F.col("i").cast("string"), F.lit(".")).alias("answer"))
    lists = spark.createDataFrame([("Quels sont les jours de la semaine ?", ", ".join(days) + "."), ("Quels sont les mois de l'année ?", ", ".join(months) + ".")], "question string, answer string")
    return around(days, "jour").unionByName(around(months, "mois")).unionByName(numbers).unionByName(lists)


def opposites(pairs: DataFrame) -> DataFrame:
    """Both ways of ``(a, b)``."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.select(F.concat(F.lit("Quel est le contraire de "), "a", F.lit(" ?")).alias("question"), F.concat(F.lit("Le contraire de "), "a", F.lit(" est "), "b", F.lit(".")).alias("answer"))


def from_templates(facts: DataFrame, templates: DataFrame, each: int, seed: int, key: str = "key") -> DataFrame:
    """``each`` of the question templates for each fact, picked by hash; ``{key}`` and ``{value}`` are filled in. Both tables are small content."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy(key).orderBy(hashing.order_key(seed, F.col(key), F.col("template"))))
    filled = facts.join(F.broadcast(templates)).withColumn("_r", rank).where(F.col("_r") <= each)
    return filled.select(key, F.replace(F.col("template"), F.lit("{key}"), F.col(key)).alias("question"), F.replace(F.replace(F.col("answer_template"), F.lit("{key}"), F.col(key)), F.lit("{value}"), F.col("value")).alias("answer"))


def picked(groups: DataFrame, times: int, seed: int) -> DataFrame:
    """``(name, questions ARRAY, answers ARRAY)``: ``times`` hashed pairs from each group."""
    rows = groups.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times))))
    at = lambda c: F.element_at(F.col(c), (F.floor(hashing.uniform(seed, c, F.col("name"), F.col("k")) * F.size(c)) + 1).cast("int"))
    return rows.select("name", "k", at("questions").alias("question"), at("answers").alias("answer"))


def inverse(facts: DataFrame, question: str, answer: str, key: str = "key") -> DataFrame:
    """One question for each fact that asks for its key; templates as in ``from_templates``."""
    filled = lambda t: F.replace(F.replace(F.lit(t), F.lit("{key}"), F.col(key)), F.lit("{value}"), F.col("value"))
    return facts.select(key, filled(question).alias("question"), filled(answer).alias("answer"))


def over_seeds(build: Callable[[int], DataFrame], seed: int, times: int) -> DataFrame:
    """``build`` for ``times`` seeds from ``seed`` on, one below the other; ``repeat`` says which."""
    return functools.reduce(DataFrame.unionByName, [build(seed + r).withColumn("repeat", F.lit(r)) for r in range(times)])


def two_turns(single: DataFrame, share: float, seed: int, key: str = "i") -> DataFrame:
    """``(k, messages)``: ``int(share * n)`` talks, each of two different talks picked by hash."""
    from lexmill.operators.order import numbered

    n = single.count()
    rows = numbered(single.select(key, "messages"), F.col(key), out="_ord")
    picks = single.sparkSession.range(int(n * share) if n > 1 else 0).withColumnRenamed("id", "k")
    picks = picks.withColumn("_a", _pick(max(1, n), seed, "first", F.col("k"))).withColumn("_b", _pick(max(1, n - 1), seed, "second", F.col("k")))
    picks = picks.withColumn("_b", F.col("_b") + (F.col("_b") >= F.col("_a")).cast("long"))
    one = rows.select(F.col("_ord").alias("_a"), F.col("messages").alias("_m"))
    two = rows.select(F.col("_ord").alias("_b"), F.col("messages").alias("_n"))
    return picks.join(one, "_a").join(two, "_b").select("k", F.concat("_m", "_n").alias("messages"))


def assembled(families: dict[str, DataFrame], seed: int, share: float = 0.15) -> DataFrame:
    """``(pos, family, messages)``: all families' ``(question, answer)`` rows as talks, talks of two of them, in an order by seed."""
    from lexmill.operators.order import numbered, shuffled

    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    talk = F.array(message("user", "question"), message("assistant", "answer")).alias("messages")
    every = functools.reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("family"), "question", "answer") for name, rows in families.items()])
    single = numbered(every, F.col("family"), F.col("question"), F.col("answer"), out="i").select("i", "family", talk)
    pairs = two_turns(single, share, seed).select(F.col("k").alias("i"), F.lit("two turns").alias("family"), "messages")
    return shuffled(single.unionByName(pairs), seed, "family", "i").select("pos", "family", "messages")
