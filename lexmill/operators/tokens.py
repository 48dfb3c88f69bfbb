"""Tokens: byte-level ids, chat templates with answer masks, packing, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.functions import hashing
from lexmill.functions.text import sanitized, strip
from lexmill.operators.order import running_sum

#: Special tokens in the order of their ids; bytes follow.
SPECIALS = ("<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>")
EOT, SYSTEM, USER, ASSISTANT, END = range(5)
ROLE = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
FIRST_BYTE = len(SPECIALS)
#: Tokens that end an answer, and those that may not stand in one; padding is the end of text.
STOP, FORBIDDEN, PAD = (END, EOT), (SYSTEM, USER, ASSISTANT), EOT


def special_tokens(spark) -> DataFrame:
    """``(id, token, stops, forbidden, pads)`` of the special tokens."""
    return spark.createDataFrame([(i, t, i in STOP, i in FORBIDDEN, i == PAD) for i, t in enumerate(SPECIALS)], "id int, token string, stops boolean, forbidden boolean, pads boolean")


def _bytes(sane: Column) -> Column:
    # Latin-1 keeps one character a byte; the split is linear in long texts, where substrings by position are not.
    single = F.split(F.decode(F.encode(sane, "UTF-8"), "ISO-8859-1"), "")
    return F.transform(F.filter(single, lambda c: c != ""), lambda c: F.ascii(c) + FIRST_BYTE)


def byte_ids(text: Column) -> Column:
    """Ids of a vocabulary without merges: one a UTF-8 byte."""
    return _bytes(sanitized(text))


def n_byte_ids(text: Column) -> Column:
    """How many ``byte_ids`` a text has, without making them."""
    return F.octet_length(sanitized(text))


def with_eot(ids: Column) -> Column:
    return F.concat(ids, F.array(F.lit(EOT)))


def role_id(role: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, i in ROLE.items():
        out = F.when(role == name, F.lit(i)).otherwise(out)
    return out


def encode_chat(messages: Column, prompt: bool = False) -> tuple[Column, Column]:
    """Ids and mask: the mask is 1 on what an assistant says and on the token that ends it."""
    sane = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), sanitized(strip(m["content"])).alias("content")))
    ids = F.flatten(F.transform(sane, lambda m: F.concat(F.array(role_id(m["role"])), _bytes(m["content"]), F.array(F.lit(END)))))
    zero, one = F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint")
    mask = F.flatten(F.transform(sane, lambda m: F.concat(F.array(zero), F.array_repeat(F.when(m["role"] == "assistant", one).otherwise(zero), F.octet_length(m["content"]) + 1))))
    return (F.concat(ids, F.array(F.lit(ASSISTANT))), F.concat(mask, F.array(zero))) if prompt else (ids, mask)


def padded_vocab(n: int, multiple: int = 64) -> int:
    return -(-n // multiple) * multiple


def blocks(docs: DataFrame, length: int, ids: str = "ids", ordinal: str = "ord", offset: int = 0, size: str | Column | None = None) -> DataFrame:
    """``(block_id, x, y)``: the stream of all documents cut into blocks of ``length`` + 1 tokens that share one.

    Each document gives only the slices that fall into the blocks it touches. Blocks inside one
    document leave it whole; only those over a border are dealt out and put together. Places
    are summed up over the sizes alone (``size``, where they are known without the ids), which
    are written once.
    """
    from lexmill.storage import stage

    n = F.size(ids) if size is None else F.col(size) if isinstance(size, str) else size
    sized = stage(docs.select(ordinal, n.cast("long").alias("_n")), "sizes")
    n_blocks = (sized.agg(F.sum("_n")).first()[0] or 0) // length - 1
    at = running_sum(sized, ordinal, "_n", "_s").select(ordinal, (F.col("_s") - offset).alias("_s"), (F.col("_s") - offset + F.col("_n")).alias("_e"))
    placed = at.where("_e > 0 and _e > _s").join(docs.select(ordinal, F.col(ids).alias("_ids")), ordinal)
    # Slices are cut before rows are made of them, so a long document isn't copied for each block.
    lo, hi = f"greatest(_s, b * {length})", f"least(_e, b * {length} + {length} + 1)"
    piece = f"named_struct('block_id', b, 'p', named_struct('_lo', {lo}, 't', slice(_ids, cast({lo} - _s + 1 as int), cast(greatest(0L, {hi} - {lo}) as int))))"
    first, last = f"(greatest(0L, greatest(_s, 0L) - 1) div {length})", f"least({n_blocks - 1}L, (_e - 1) div {length})"
    inside = f"(b * {length} >= _s and b * {length} + {length} + 1 <= _e)"

    def cut(which: str) -> DataFrame:
        touched = f"filter(case when {first} <= {last} then sequence({first}, {last}) else array() end, b -> {which})"
        return placed.select(F.explode(F.expr(f"transform({touched}, b -> {piece})")).alias("x")).select("x.block_id", "x.p").where(F.size("p.t") > 0)

    whole = cut(inside).select("block_id", F.col("p.t").alias("t"))
    parts = cut(f"not {inside}").groupBy("block_id").agg(F.array_sort(F.collect_list("p")).alias("p")).select("block_id", F.flatten(F.transform("p", lambda p: p["t"])).alias("t"))
    return whole.unionByName(parts).select("block_id", F.slice("t", 1, length).alias("x"), F.slice("t", 2, length).alias("y"))


def epoch_positions(blocks_: DataFrame, seed: int, epoch: int, key: str = "block_id") -> DataFrame:
    """``pos``: each block's place in the epoch's order; every block once."""
    from lexmill.operators.order import numbered

    return numbered(blocks_, hashing.order_key(seed, epoch, F.col(key)), F.col(key), out="pos")


def slots(spark, steps: int, batch: int, rank: int, world: int, n_blocks: int) -> DataFrame:
    """``(g, j, epoch, pos)``: which place of which epoch each row of a rank's batches takes."""
    s = f"((g * {world} + {rank}) * {batch} + j)"
    grid = spark.range(steps * batch).select(F.expr(f"id div {batch}").alias("g"), F.expr(f"id % {batch}").alias("j"))
    return grid.select("g", "j", F.expr(f"{s} div {n_blocks}").alias("epoch"), F.expr(f"{s} % {n_blocks}").alias("pos"))


def validation_blocks(spark, n_blocks: int, need: int, rank: int = 0, world: int = 1) -> DataFrame:
    """``(i, block_id)``: evenly spread blocks, the same each time, dealt to the ranks in turn."""
    k = min(need, n_blocks)
    grid = spark.range(k).select(
        F.when(F.col("id") == k - 1, F.lit(n_blocks - 1)).otherwise(F.floor(F.col("id") * F.lit((n_blocks - 1) / max(1, k - 1)))).cast("long").alias("block_id")
        if k > 1 else F.lit(0).cast("long").alias("block_id")
    )
    i = F.row_number().over(Window.orderBy("block_id")).cast("long") - 1  # need rows at most
    return grid.distinct().withColumn("i", i).where(F.col("i") % world == rank).select("i", "block_id")


def bucketed_batches(examples: DataFrame, batch: int, seed: int, epoch: int, multiple: int = 32, key: str = "ord", length: str = "n", rank: int = 0, world: int = 1) -> DataFrame:
    """``(key, length, chunk, batch_no, row_no, place)``: rows of like length share a batch; batches come in random order, by ``place``.

    The epoch's order is cut off at whole batches on each of the ``world`` ranks and dealt to
    them in turn; a rank's part is cut into chunks of ``batch * multiple``, each sorted by
    length.
    """
    from lexmill.operators.order import numbered

    whole = examples.count() // world // batch * batch * world
    placed = epoch_positions(examples.select(key, length), seed, epoch, key).where((F.col("pos") < whole) & (F.col("pos") % world == rank))
    chunked = placed.withColumn("pos", F.expr(f"pos div {world}")).withColumn("chunk", F.expr(f"pos div {batch * multiple}"))
    within = Window.partitionBy("chunk").orderBy(length, "pos")
    rows = chunked.withColumn("_r", F.row_number().over(within).cast("long") - 1).select(key, length, "chunk", F.expr(f"_r div {batch}").alias("batch_no"), F.expr(f"_r % {batch}").alias("row_no"))
    named = rows.where("row_no = 0").select("chunk", "batch_no", hashing.order_key(seed, epoch, "batch", F.col("chunk"), F.col("batch_no")).alias("_key"))
    return rows.join(numbered(named, F.col("_key"), F.col("chunk"), F.col("batch_no"), out="place").drop("_key"), ["chunk", "batch_no"]).select(key, length, "chunk", "batch_no", "row_no", "place")


def evaluation_batches(examples: DataFrame, batch: int, rank: int = 0, world: int = 1, most: int = 0, key: str = "ord", length: str = "n") -> DataFrame:
    """``(key, batch_no, row_no)``: rows by length in consecutive batches, dealt to the ranks in turn; with ``most``, a rank's first so many."""
    from lexmill.operators.order import numbered

    placed = numbered(examples.select(key, length), F.col(length), F.col(key), out="pos").withColumn("_b", F.expr(f"pos div {batch}"))
    mine = placed.where(F.col("_b") % world == rank).select(key, F.expr(f"_b div {world}").alias("batch_no"), F.expr(f"pos % {batch}").alias("row_no"))
    return mine.where(F.col("batch_no") < most) if most else mine


def collated(examples: DataFrame, by: list[str], ids: str = "ids", mask: str = "mask", pad: int = EOT) -> DataFrame:
    """``x`` padded to the batch's longest; ``y`` is the next id where its mask is 1, else -1."""
    most = F.max(F.size(ids)).over(Window.partitionBy(*by)) - 1
    n = F.size(ids) - 1
    y = F.zip_with(F.slice(F.col(ids), F.lit(2), n), F.slice(F.col(mask), F.lit(2), n), lambda i, m: F.when(m > 0, i).otherwise(F.lit(-1)))
    return examples.withColumn("_most", most).select(
        *[c for c in examples.columns if c not in (ids, mask)],
        F.concat(F.slice(F.col(ids), F.lit(1), n), F.array_repeat(F.lit(pad), F.col("_most") - n)).alias("x"),
        F.concat(y, F.array_repeat(F.lit(-1), F.col("_most") - n)).alias("y"),
    )
