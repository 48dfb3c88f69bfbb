"""Question-answer data for fine-tuning: sources to conversations, filters, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import hashing
from lexmill.functions.text import first_filled, strip
from lexmill.operators.corpus import survivors

#: Phrases about the assistant's identity in questions and in answers.
ASKS_WHO = (
    "qui es-tu", "qui êtes-vous", "tu es qui", "comment t'appelles", "comment vous appelez", "ton nom", "ton prénom", "qui t'a créé",
    "qui t'a conçu", "es-tu un", "es-tu une", "présente-toi", "présentez-vous",
)
SAYS_WHO = (
    "openai", "chatgpt", "gpt-3", "gpt-4", "en tant qu'ia", "en tant qu'intelligence artificielle", "en tant que modèle de langage",
    "en tant qu'assistant", "en tant qu'ai", "je suis une ia", "je suis une intelligence artificielle", "je suis un assistant",
    "assistant virtuel", "open assistant", "open-assistant", "laion",
)
QUESTION_KEYS, INPUT_KEYS, ANSWER_KEYS = ("instruction", "question", "prompt", "query"), ("input", "context"), ("output", "response", "answer", "completion")


def pair(question: Column, answer: Column) -> Column:
    """A conversation of one question and one answer, both stripped."""
    message = lambda role, c: F.struct(F.lit(role).alias("role"), strip(c).alias("content"))
    return F.array(message("user", question), message("assistant", answer))


def about_identity(question: Column, answer: Column, in_question=ASKS_WHO, in_answer=SAYS_WHO) -> Column:
    """Whether a pair says who the assistant is: such pairs would contradict the persona that is trained in."""
    plain = lambda c: F.replace(F.lower(c), F.lit("’"), F.lit("'"))
    found = lambda c, phrases: F.exists(F.array(*map(F.lit, phrases)), lambda k: F.contains(c, k))
    return found(plain(question), in_question) | found(plain(answer), in_answer)


def instructions(rows: DataFrame, most_answer: int = 350, most_question: int = 300) -> DataFrame:
    """``(question, answer)`` of instruction rows under any of their usual names that pass the filters.

    A row needs an instruction of its own: an input alone isn't one. Markup and links are
    looked for in the answer only.
    """
    known = lambda names: first_filled(*[F.col(n) for n in names if n in rows.columns])
    out = rows.withColumn("_i", known(QUESTION_KEYS)).withColumn("_m", known(INPUT_KEYS)).withColumn("_a", known(ANSWER_KEYS))
    out = out.withColumn("_q", F.when(F.col("_m") == "", F.col("_i")).otherwise(F.concat("_i", F.lit("\n\n"), "_m")))
    short = (F.length("_q") <= most_question) & F.length("_a").between(3, most_answer)
    clean = ~F.contains("_a", F.lit("###")) & ~F.contains("_a", F.lit("http"))
    kept = out.where((F.col("_i") != "") & (F.col("_a") != "") & short & clean & ~about_identity(F.col("_q"), F.col("_a")))
    return kept.drop("_i", "_m", "question", "answer").withColumnRenamed("_q", "question").withColumnRenamed("_a", "answer")


def replies(tree: DataFrame, lang: str = "fr", most_question: int = 400, most_answer: int = 500, most: int | None = None, seed: int = 0, ordinal: str = "ord") -> DataFrame:
    """``(message_id, question, answer)``: best-ranked assistant messages with the prompt they answer, by a self-join on the parent.

    Of rows with the same id in this language the last by ``ordinal`` counts. With ``most``,
    so many pairs in an order by seed.
    """
    told = F.max_by(F.struct("parent_id", "role", "text", "rank"), F.col(ordinal))
    own = tree.where(F.col("lang") == lang).groupBy("message_id").agg(told.alias("m")).select("message_id", "m.*")
    parents = own.where(F.col("role") == "prompter").select(F.col("message_id").alias("parent_id"), F.col("text").alias("question"))
    answers = own.where((F.col("role") == "assistant") & (F.col("rank").isNull() | (F.col("rank") == 0))).select("message_id", "parent_id", F.col("text").alias("answer"))
    both = answers.join(parents, "parent_id").select("message_id", strip(F.col("question")).alias("question"), strip(F.col("answer")).alias("answer"))
    kept = both.where((F.length("question") <= most_question) & F.length("answer").between(3, most_answer) & ~about_identity(F.col("question"), F.col("answer")))
    return survivors(kept, "answer", most, seed, "message_id") if most else kept


def with_split(examples: DataFrame, permille: int, messages: str = "messages") -> DataFrame:
    key = F.element_at(F.col(messages), 1)["content"]
    return examples.withColumn("split", F.when(hashing.in_validation(key, permille, None), F.lit("val")).otherwise(F.lit("train")))


def fits(examples: DataFrame, most: int, ids: str = "ids", mask: str = "mask") -> DataFrame:
    """``kept``: short enough to be used whole, with an answer in it. Nothing is truncated."""
    answered = F.aggregate(mask, F.lit(0), lambda n, x: n + x.cast("int"))
    return examples.withColumn("n_answer", answered).withColumn("kept", (F.size(ids) <= most + 1) & (F.col("n_answer") > 0))


def fallback_validation(examples: DataFrame, least: int = 50, ordinal: str = "ord") -> DataFrame:
    """If too few examples are held out, every step-th training example moves over, the first one first."""
    counts = examples.groupBy("split").agg(F.count("*").alias("n")).collect()  # two rows
    n = {r["split"]: r["n"] for r in counts}
    if n.get("val", 0) >= least:
        return examples
    return moved_over(examples, n.get("train", 0), ordinal)


def moved_over(examples: DataFrame, n_train: int | None = None, ordinal: str = "ord") -> DataFrame:
    """Every step-th training example moved to validation, the first one first, however many are held out: some 50, or half if there are fewer than 150."""
    from lexmill.operators.order import numbered

    training = examples.where("split = 'train'")
    step = max(2, (training.count() if n_train is None else n_train) // 50)
    train = numbered(training, F.col(ordinal), out="_i").withColumn("split", F.when(F.col("_i") % step == 0, F.lit("val")).otherwise(F.lit("train"))).drop("_i")
    return train.unionByName(examples.where("split = 'val'"))


def add_persona(examples: DataFrame, persona: DataFrame, times: int, most: int | None = None) -> DataFrame:
    """Persona examples go to training only, ``times`` each; with ``most``, those that don't fit are left out, uncounted."""
    if most is not None:
        persona = fits(persona, most).where("kept").drop("kept", "n_answer")
    copies = persona.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("split", F.lit("train"))
    return examples.unionByName(copies.drop("copy_no"), allowMissingColumns=True)


def source_report(examples: DataFrame, persona_source: str = "persona", times: int = 1) -> DataFrame:
    """Kept examples of each source and those too long; persona counts once each, not by copies."""
    name = F.when(F.col("src") == persona_source, F.lit(f"{persona_source} (x{times})")).otherwise(F.col("src"))
    return examples.groupBy(name.alias("src")).agg(
        F.sum(F.col("kept").cast("long")).alias("kept"), F.sum(F.when(~F.col("kept") & (F.col("src") != persona_source), 1).otherwise(0)).alias("skipped_too_long")
    )
