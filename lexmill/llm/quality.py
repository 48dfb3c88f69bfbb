"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Features are computed inside each row. Each rule rejects documents whose feature reaches a
cutoff. Cutoffs come from labelled good documents of the same stratum: candidate cutoffs are
tested from the mildest to the strictest, and one is accepted while the exact binomial tail
``P(Bin(n, alpha / rules) <= false rejections)`` is at most ``delta / (rules * strata)``
(the Clopper-Pearson bound lies below the limit). The order of tests is fixed in advance, so
stopping at the first failure needs no further correction inside a rule, and the division by
rules and strata is Bonferroni's. With probability 1 - delta no stratum loses more than
``alpha`` of its good documents to the rules together.

Defined results: null and empty texts have no words and fail the base; null strata form a
stratum of their own; strata too small to certify a cutoff reject nothing; repeated rows are
judged each for itself, and a repeated label row counts once (a document labelled both ways
counts as good); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.storage import stage

#: White space between words.
SPACES = ("\t", "\n", "\x0b", "\x0c", "\r")

#: Rules as (name, feature as SQL over the counts); a document is rejected where the feature reaches its cutoff.
RULES = (
    ("symbols", "n_symbols / word_chars"),
    ("repeats", "n_repeat_words / n_words"),
    ("dup_lines", "n_dup_lines / n_lines"),
    ("short_words", "- word_chars / n_words"),
    ("long_words", "word_chars / n_words"),
)


def words_of(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def features(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of each row.

    Repeated 3-word windows are found without leaving the row: each window becomes one long
    of hash bits above and its position below; after a primitive sort equal windows are
    neighbours, and neighbours with equal hash bits are compared word by word.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(*keep, text.alias("_t"), words_of(text).alias("_w"), F.filter(F.split(text, "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    b = a.select(
        *keep,
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.expr("case when size(_w) < 65536 then 16 when size(_w) < 16777216 then 24 else 31 end").alias("_bits"),
    )
    c = b.withColumn(
        "_g",
        F.expr(
            "case when n_words < 4 then array() else array_sort(transform(sequence(0, size(_w) - 3),"
            " i -> (xxhash64(_w[i], _w[i + 1], _w[i + 2]) & ~(shiftleft(1L, _bits) - 1L)) | i)) end"
        ).cast("array<long>"),
    )
    same = (
        "(shiftright(x, _bits) = shiftright(_g[{j}], _bits)"
        " and _w[cast(x & (shiftleft(1L, _bits) - 1) as int)] = _w[cast(_g[{j}] & (shiftleft(1L, _bits) - 1) as int)]"
        " and _w[cast(x & (shiftleft(1L, _bits) - 1) as int) + 1] = _w[cast(_g[{j}] & (shiftleft(1L, _bits) - 1) as int) + 1]"
        " and _w[cast(x & (shiftleft(1L, _bits) - 1) as int) + 2] = _w[cast(_g[{j}] & (shiftleft(1L, _bits) - 1) as int) + 2])"
    )
    d = c.withColumn("_r", F.expr(f"filter(_g, (x, i) -> (i > 0 and {same.format(j='i - 1')}) or (i < size(_g) - 1 and {same.format(j='i + 1')}))"))
    e = d.withColumn("_p", F.expr("transform(_r, x -> cast(x & (shiftleft(1L, _bits) - 1) as int))"))
    repeats = F.expr("case when size(_p) = 0 then 0L else cast(size(array_distinct(flatten(transform(_p, p -> array(p, p + 1, p + 2))))) as long) end")
    return e.select(*keep, "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeats.alias("n_repeat_words"))


def binomial_tail(k: str, n: str, p: float) -> Column:
    """``P(Bin(n, p) <= k)`` exactly, summed in logarithms by a fold over 1..k."""
    start = f"{n} * ln(1D - {p!r}D)"
    term = f"(z.t + ln(cast({n} - i + 1 as double) / i) + ln({p!r}D / (1D - {p!r}D)))"
    return F.expr(
        f"exp(aggregate(case when {k} < 1 then cast(array() as array<int>) else sequence(1, cast({k} as int)) end,"
        f" named_struct('t', {start}, 's', {start}),"
        f" (z, i) -> named_struct('t', {term}, 's', greatest(z.s, {term}) + log1p(exp(-abs(z.s - {term})))),"
        " z -> z.s))"
    )


def cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    stratum: str,
    alpha: float = 0.05,
    delta: float = 0.05,
    grid: int = 40,
    id_col: str = "doc_id",
    label_col: str = "quality",
) -> DataFrame:
    """``(stratum, rule, cutoff)``: the strictest certified cutoff of each rule in each stratum.

    ``measured`` has the id, the stratum and one column per rule. Candidate cutoffs are the
    upper quantiles of labelled bad and good documents together, ``grid`` of them, fixed before
    the good documents' losses are seen one by one. All labelled rows are used.
    """
    good = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_good"))
    names = [n for n, _ in RULES]
    held = (
        measured.where(~F.col("base_failed"))
        .join(good, id_col)
        .select(stratum, (F.col("_good") >= 1).alias("_good"), F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("x")) for n in names])).alias("r"))
        .select(stratum, "_good", "r.rule", "r.x")
        .where(F.col("x").isNotNull())
    )
    # One row for each value, stratum and rule: what follows depends on distinct values, not on rows.
    points = F.array(*[F.lit(i / grid) for i in range(grid)])
    candidates = (
        held.groupBy("rule").agg(F.percentile_approx("x", points, 10_000).alias("q"), F.max("x").alias("m"))
        .select("rule", F.explode(F.array_distinct(F.concat(F.col("q"), F.array("m")))).alias("cutoff"))
    )
    losses = (
        held.where("_good")
        .groupBy(stratum, "rule", "x").agg(F.count("*").alias("n"))
        .join(F.broadcast(candidates), "rule")  # at most rules * (grid + 1) rows
        .groupBy(stratum, "rule", "cutoff")
        .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") >= F.col("cutoff"), F.col("n")).otherwise(0)).alias("k"))
    )
    strata = losses.select(stratum).distinct().agg(F.count("*").alias("strata"))
    tested = losses.crossJoin(F.broadcast(strata)).withColumn(  # one row
        # The tail is summed only where the losses lie below the limit, in as many steps as there are losses.
        "ok", F.when(F.col("k") <= F.col("n") * (alpha / len(RULES)), binomial_tail("k", "n", alpha / len(RULES)) <= delta / len(RULES) / F.col("strata")).otherwise(False)
    )
    # The strictest cutoff above which every milder one passed too.
    failed = F.max(F.when(~F.col("ok"), F.col("cutoff")))
    return (
        tested.groupBy(stratum, "rule").agg(failed.alias("stop"), F.collect_list(F.when(F.col("ok"), F.col("cutoff"))).alias("passed"))
        .select(stratum, "rule", F.array_min(F.filter("passed", lambda c: F.col("stop").isNull() | (c > F.col("stop")))).alias("cutoff"))
        .where(F.col("cutoff").isNotNull())
    )


def judge(docs: DataFrame, labels: DataFrame, stratum_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", **risk) -> DataFrame:
    """Counts, ``base_failed``, ``kept`` and the rules broken, for each row of ``docs``.

    ``row_hash``, of the text and the stratum, tells rows that share an id apart.
    """
    keyed = docs.select(F.col(id_col), F.col(text_col), F.col(stratum_col).cast("string").alias("stratum"), F.xxhash64(text_col, stratum_col).alias("row_hash"))
    counted = features(keyed, [id_col, "stratum", "row_hash"], text_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = stage(counted.withColumn("base_failed", failed), "quality").select(
        "*", *[F.expr(f"case when n_words > 0 then cast({x} as double) end").alias(n) for n, x in RULES]
    )
    found = cutoffs(measured, labels, "stratum", id_col=id_col, **risk)
    # One row for each stratum; there are as many strata as labelled languages, so its size is that of the list of languages.
    wide = stage(found.groupBy("stratum").pivot("rule", [n for n, _ in RULES]).agg(F.min("cutoff")), "cutoffs")
    wide = wide.select("stratum", *[F.col(n).alias(f"cut_{n}") for n, _ in RULES])
    broken = F.filter(F.array(*[F.when(F.col(n) >= F.col(f"cut_{n}"), F.lit(n)) for n, _ in RULES]), lambda x: x.isNotNull())
    return (
        measured.join(wide.withColumnRenamed("stratum", "_stratum"), F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
        .withColumn("broken", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(broken))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
        .select(id_col, "row_hash", "stratum", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "broken")
    )
