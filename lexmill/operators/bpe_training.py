"""Training a byte-level BPE vocabulary as rounds over two tables: spelled words and pair counts.

Words and pair counts stay on the executors. A round takes the most frequent pairs (a bounded
list) to the driver, settles how many of them repeated merging would take next whatever the
merges before them do, merges these in one pass over the words, and adds to the pair counts
what changed in the words they touched.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import LATIN_PRE_TOKEN, is_latin, pre_tokens, sanitized
from lexmill.functions.unicode import composed
from lexmill.operators.tokens import FIRST_BYTE, SPECIALS
from lexmill.storage import free, stage

#: Pairs looked at in a round; a round merges some of them.
LISTED = 512
#: Distinct words that a task counts or keeps before it begins anew.
KNOWN = 400_000


def word_frequencies(docs: DataFrame, text: str = "text", min_frequency: int = 2) -> DataFrame:
    """Latin texts are cut and counted in Arrow batches, so that only a task's counts are shuffled; others natively."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = re.compile(LATIN_PRE_TOKEN).findall
        counts: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for one in batch.column(0):
                counts.update(cut(one.as_py().replace("<|", "< |")))
                if len(counts) >= KNOWN:
                    yield counted()
                    counts.clear()
        if counts:
            yield counted()

    latin = docs.where(is_latin(F.col(text))).select(text).mapInArrow(run, "word string, n long")
    others = docs.where(~is_latin(F.col(text))).select(F.explode(pre_tokens(composed(sanitized(F.col(text))))).alias("word"), F.lit(1).cast("long").alias("n"))
    words = latin.unionByName(others)
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_frequency)


def _spelled(word: Column) -> Column:
    """A word's tokens as hexadecimal bytes, each with a blank behind it: whole tokens can be replaced, and compare as bytes do."""
    return F.regexp_replace(F.lower(F.hex(F.encode(word, "UTF-8"))), "(..)", "$1 ")


def _pairs(spelled: str) -> Column:
    """Neighbouring tokens; repeated as often as they stand side by side."""
    parts = F.split(F.rtrim(F.col(spelled)), " ")
    return F.transform(F.array(parts), lambda p: F.arrays_zip(F.slice(p, F.lit(1), F.size(p) - 1).alias("left"), F.slice(p, F.lit(2), F.size(p) - 1).alias("right")))[0]


def next_merges(listed: list[tuple[str, str, int]], whole: bool, most: int) -> list[tuple[str, str]]:
    """Of pairs with counts, most frequent first, those that merging one by one would take next, in that order.

    Merging (a, b) changes the counts of pairs that end in a or begin with b, and makes pairs
    that come at most as often as those did. Pairs down to the first changed one keep their
    counts; they go next if they are more frequent than anything that can be made, or as
    frequent and smaller. ``whole``: all pairs are listed.
    """
    taken: list[tuple[str, str, int]] = []
    ceiling = 0
    for left, right, n in listed:
        if any(right == a or left == b for a, b, _ in taken) or (taken and taken[-1][0] == taken[-1][1]):
            ceiling = n
            break
        taken.append((left, right, n))
    else:
        ceiling = 0 if whole or not listed else listed[-1][2]
    out: list[tuple[str, str]] = []
    for left, right, n in taken[:most]:
        if out and (n < ceiling or n == ceiling and not all(left < a + b for a, b in out)):
            break
        out.append((left, right))
    return out


def merged(spelled: Column, pairs: list[tuple[str, str]]) -> Column:
    """All occurrences of the pairs, which share no token at their seams, joined from left to right."""
    either = "|".join(f"({a}) ({b}) " for a, b in pairs)
    joined = "".join(f"${i + 1}" for i in range(2 * len(pairs)))
    return F.regexp_replace(spelled, f"(?<![0-9a-f])(?:{either})", f"{joined} ")


def learn(words: DataFrame, vocab_size: int, min_frequency: int = 2, listed: int = LISTED) -> list[tuple[bytes, bytes]]:
    """Merges learned from ``(word, n)``: the most frequent pair first, ties to the smaller pair.

    The same whatever the order and partitioning of the words. Only the merges, of which
    ``vocab_size`` is the bound, and ``listed`` pairs a round come to the driver.
    """
    state = stage(words.select(_spelled(F.col("word")).alias("s"), F.col("n").cast("long").alias("n")).where("length(s) > 3"), "bpe-words")
    counted = state.select("n", F.explode(_pairs("s")).alias("p")).groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))
    pairs = stage(counted, "bpe-pairs")
    out: list[tuple[bytes, bytes]] = []
    while (room := vocab_size - FIRST_BYTE - 256 - len(out)) > 0:
        top = [(r["left"], r["right"], r["n"]) for r in pairs.where(F.col("n") >= min_frequency).orderBy(F.col("n").desc(), "left", "right").limit(listed).collect()]
        if not top:
            break
        now = next_merges(top, len(top) < listed, room)
        out += [(bytes.fromhex(a), bytes.fromhex(b)) for a, b in now]
        # Words that are one token have no pairs left: they leave the table.
        after = state.withColumn("t", merged(F.col("s"), now))
        moved = stage(after.select("n", F.when(F.col("s") != F.col("t"), F.col("s")).alias("was"), F.col("t").alias("s")).where("was is not null or s like '% %_'"), "bpe-words")
        touched = moved.where("was is not null")
        change = touched.select((-F.col("n")).alias("n"), F.explode(_pairs("was")).alias("p")).unionByName(touched.select("n", F.explode(_pairs("s")).alias("p"))).select("p.left", "p.right", "n")
        counts = stage(pairs.unionByName(change).groupBy("left", "right").agg(F.sum("n").alias("n")).where("n > 0"), "bpe-pairs")
        free(pairs, state)
        state, pairs = moved.drop("was"), counts
        state.staged_at = moved.staged_at
    free(pairs, state)
    return out


def train(docs: DataFrame, vocab_size: int = 32_000, text: str = "text", min_frequency: int = 2) -> list[tuple[bytes, bytes]]:
    return learn(word_frequencies(docs, text, min_frequency), vocab_size, min_frequency)


class Tokenizer:
    """Ids of learned merges: special tokens, then bytes, then merges in the order they were learned."""

    def __init__(self, learned: list[tuple[bytes, bytes]]):
        self.rank = {pair: i for i, pair in enumerate(learned)}
        self.spelled = [s.encode() for s in SPECIALS] + [bytes([b]) for b in range(256)] + [a + b for a, b in learned]
        self.id_of = {s: i for i, s in enumerate(self.spelled) if i >= FIRST_BYTE}

    @classmethod
    def of(cls, vocabulary: list[dict]) -> Tokenizer:
        """From rows as ``rows`` gives them; a vocabulary without the special tokens is refused."""
        if absent := [t for t in SPECIALS if t not in {r["token"] for r in vocabulary}]:
            raise ValueError(f"the vocabulary lacks {', '.join(absent)}")
        learned = [(bytes.fromhex(r["left"]), bytes.fromhex(r["right"])) for r in sorted(vocabulary, key=lambda r: r["id"]) if r["left"]]
        return cls(learned)

    def rows(self) -> list[dict]:
        """``{id, token, left, right}`` of the whole vocabulary; token as text for special ones, as hex for others."""
        halves = dict(zip(range(FIRST_BYTE + 256, len(self.spelled)), self.rank, strict=True))
        return [
            {"id": i, "token": SPECIALS[i] if i < FIRST_BYTE else t.hex(), "left": halves[i][0].hex() if i in halves else "", "right": halves[i][1].hex() if i in halves else ""}
            for i, t in enumerate(self.spelled)
        ]

    def missing(self, tokens: list[str]) -> list[str]:
        """Of the given special tokens those that the vocabulary lacks."""
        known = {t.decode("utf-8", "replace") for t in self.spelled[:FIRST_BYTE]}
        return [t for t in tokens if t not in known]

    def word(self, word: str) -> list[int]:
        """Ids of one pre-token: neighbours in a queue by rank, then place, so that long words take n log n steps."""
        parts: list[bytes | None] = [bytes([b]) for b in word.encode()]
        n, rank = len(parts), self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, i + 1) for i, pair in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank.get(pair)) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, j = heapq.heappop(queue)
            if parts[i] is None or after[i] != j or j >= n or rank.get((parts[i], parts[j])) != r:
                continue  # one of the two was merged meanwhile
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(queue, (found, x, y))
        return [self.id_of[p] for p in parts if p is not None]

    def decode(self, ids: list[int], skip_special: bool = True) -> str:
        return b"".join(self.spelled[i] for i in ids if not (skip_special and i < FIRST_BYTE)).decode("utf-8", "replace")

    def encode_col(self, text: Column) -> Column:
        """``ARRAY<INT>``: sanitized, composed, cut natively, merged in Arrow batches with the words met so far kept."""
        return self._native(text)

    def _native(self, text: Column, decode: bool = False) -> Column:
        return self._merging(lambda pieces: pieces or (), decode)(pre_tokens(composed(sanitized(F.coalesce(text, F.lit(""))))))

    def encode(self, docs: DataFrame, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
        """``docs`` with ``out``, the same ids; Latin texts are cut where they are merged. ``decoded``: a column for what all ids of a text decode to."""
        cut = re.compile(LATIN_PRE_TOKEN).findall
        latin = F.coalesce(is_latin(F.col(text)), F.lit(True))
        decode = decoded is not None
        own = self._merging(lambda t: cut((t or "").replace("<|", "< |")), decode)
        made = docs.where(latin).withColumn(out, own(F.col(text))).unionByName(docs.where(~latin).withColumn(out, self._native(F.col(text), decode)))
        return made.withColumns({out: F.col(out)["ids"], decoded: F.col(out)["decoded"]}) if decode else made

    def decode_col(self, ids: Column, skip_special: bool = True) -> Column:
        """``STRING`` of ``ARRAY<INT>``, as ``decode`` gives it; null for null."""
        spelled = [b"" if skip_special and i < FIRST_BYTE else t for i, t in enumerate(self.spelled)]

        @F.arrow_udf(T.StringType())
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            one = spelled.__getitem__
            for batch in batches:
                yield pa.array([b"".join(map(one, x.values.to_numpy().tolist())).decode("utf-8", "replace") if x.is_valid else None for x in batch], pa.string())

        return run(ids)

    def _merging(self, cut, decode: bool = False):
        """An Arrow function from what ``cut`` makes pieces of to ids; with ``decode`` to ``(ids, decoded)``, decoded in the same worker."""
        shared = self
        ids_type = T.ArrayType(T.IntegerType())

        def spelled(row: bytes) -> str:
            ids, one = np.frombuffer(row, "<i4"), shared.spelled.__getitem__
            return b"".join(b"".join(map(one, ids[i : i + 65_536].tolist())) for i in range(0, len(ids), 65_536)).decode("utf-8", "replace")

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= KNOWN:
                    self.clear()
                ids = np.array(shared.word(word), "<i4").tobytes()
                if len(word) <= 256:
                    self[word] = ids
                return ids

        @F.arrow_udf(T.StructType().add("ids", ids_type).add("decoded", T.StringType()) if decode else ids_type)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = Known()
            for batch in batches:
                for at in range(0, len(batch), 256):  # bounds what is held encoded and decoded at once
                    rows = [b"".join(map(known.__getitem__, cut(x.as_py()))) for x in batch.slice(at, 256)]
                    offsets = np.cumsum([0, *(len(r) // 4 for r in rows)])
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4"), pa.int32()))
                    yield pa.StructArray.from_arrays([ids, pa.array(map(spelled, rows), pa.string())], ["ids", "decoded"]) if decode else ids

        return run
