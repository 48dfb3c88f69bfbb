"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities over the pieces of a fixed public vocabulary. A word's
probability is the sum over all its segmentations into pieces, by the forward algorithm; a
text's is the product over its words. Pieces never span white space, so the sum over a whole
text's segmentations factors into words exactly, and each distinct word is scored once a
worker. Probabilities are learned by expectation maximisation over word counts: expected
piece counts by forward-backward on the executors, renormalised on the driver, where there
are only vocabulary times languages of them.

Text is read as lower-cased runs of letters, each a word with the vocabulary's word mark.
Characters outside the vocabulary take its unknown piece.

Defined results: null texts and texts without letters are ``und`` with score 0; rows whose id
is null are predicted and never learned from; with nothing to learn from every text is
``und``; repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.worker import kept
from lexmill.storage import stage

UNKNOWN = "und"
WORD_MARK = "▁"


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces; index 0 stands for characters that no piece covers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return ["", *(model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))]


class Lattice:
    """Words laid out as piece ids: ``ids[w, i, k]`` is the piece that ends at ``i + 1`` and is ``k + 1`` long, or -1.

    Pieces are found by 64-bit polynomial hashes of all substrings at once, length by length.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, pieces: list[str]):
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(pieces):
            if p:
                by_length.setdefault(len(p), []).append((self._hash(p), i))
        self.longest = max(by_length, default=1)
        self.known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, found in by_length.items():
            found.sort()
            self.known[n] = np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found], np.int32)
            if len(np.unique(self.known[n][0])) < len(found):
                raise ValueError("two pieces have the same hash")

    def _hash(self, piece: str) -> int:
        out = 0
        for c in piece:
            out = (out * self.BASE + ord(c)) % (1 << 64)
        return out

    def lay(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word positions and their lattices, in groups of equal length and bounded size."""
        by_length: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(at)
        for n, found in by_length.items():
            width, step = min(n, self.longest), max(1, 400_000 // (n * min(n, self.longest)))
            for start in range(0, len(found), step):
                part = found[start : start + step]
                line = "".join([WORD_MARK + words[at] for at in part]).encode("utf-32-le")
                chars = np.frombuffer(line, np.uint32).reshape(len(part), n).astype(np.uint64)
                ids = np.full((len(part), n, width), -1, np.int32)
                h = chars
                for k in range(1, width + 1):
                    if k > 1:
                        h = h[:, :-1] * np.uint64(self.BASE) + chars[:, k - 1 :]
                    if k in self.known:
                        table, own = self.known[k]
                        at = np.searchsorted(table, h).clip(max=len(table) - 1)
                        ids[:, k - 1 :, k - 1] = np.where(table[at] == h, own[at], -1)
                np.maximum(ids[:, :, 0], 0, out=ids[:, :, 0])  # characters that no piece covers
                yield np.array(part), ids


def word_scores(lattice: Lattice, words: list[str], probs: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language: the forward algorithm over all segmentations."""
    out = np.zeros((len(words), probs.shape[1]))
    padded = np.vstack([probs, np.zeros((1, probs.shape[1]))])  # -1: no such piece
    for at, ids in lattice.lay(words):
        ahead = [np.ones((len(at), probs.shape[1]))]
        logs = np.zeros((len(at), probs.shape[1]))
        for i in range(ids.shape[1]):
            now = np.zeros_like(logs)
            for k in range(min(i + 1, ids.shape[2])):
                now += ahead[-1 - k] * padded[ids[:, i, k]]
            ahead.append(now)
            ahead = ahead[-ids.shape[2] :] if len(ahead) > ids.shape[2] else ahead
            if i % 8 == 7:  # before products leave the range of doubles
                scale = now
                ahead = [a / scale for a in ahead]
                logs += np.log(scale)
        out[at] = logs + np.log(ahead[-1])
    return out


def expected_counts(lattice: Lattice, words: list[str], langs: np.ndarray, counts: np.ndarray, probs: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language over all segmentations of counted words."""
    total = np.zeros(probs.shape)
    with np.errstate(divide="ignore"):
        padded = np.vstack([np.log(probs), np.full((1, probs.shape[1]), -np.inf)])
    for at, ids in lattice.lay(words):
        lang, n, width = langs[at], ids.shape[1], ids.shape[2]
        p = padded[ids, lang[:, None, None]]
        ahead = np.full((len(at), n + 1), -np.inf)
        back = ahead.copy()
        ahead[:, 0] = back[:, n] = 0
        for i in range(n):
            for k in range(min(i + 1, width)):
                ahead[:, i + 1] = np.logaddexp(ahead[:, i + 1], ahead[:, i - k] + p[:, i, k])
        for i in range(n - 1, -1, -1):
            for k in range(min(i + 1, width)):
                back[:, i - k] = np.logaddexp(back[:, i - k], back[:, i + 1] + p[:, i, k])
        for k in range(width):
            use = np.exp(ahead[:, : n - k] + p[:, k:, k] + back[:, k + 1 :] - ahead[:, n:]) * counts[at][:, None]
            np.add.at(total, (ids[:, k:, k].ravel().clip(0), np.repeat(lang, n - k)), use.ravel())
    return total


def _letters():
    import regex

    return regex.compile(r"\p{L}+").findall


@dataclass
class Model:
    langs: list[str]
    probs: np.ndarray  # pieces x languages


def word_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``(lang, word, n)`` of the lower-cased words of all given texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = _letters(), Counter()

        def flush():
            keys = list(total)
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([total[k] for k in keys], pa.int64())], ["lang", "word", "n"]
            )
            total.clear()
            return out

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for w, n in Counter(find((text.as_py() or "").lower())).items():
                    total[lang, w] += n
                if len(total) > 200_000:
                    yield flush()
        yield flush()

    parts = docs.select(F.col(text_col), F.col(lang_col).cast("string")).mapInArrow(run, "lang string, word string, n long")
    return parts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(
    docs: DataFrame,
    vocabulary: str,
    lang_col: str = "lang",
    text_col: str = "text",
    id_col: str = "doc_id",
    sample_docs: int = 20_000,
    rounds: int = 2,
    smoothing: float = 0.02,
) -> Model:
    """Piece probabilities of each language from the labelled rows of ``docs``.

    ``sample_docs`` bounds the rows learned from. Each language may give an equal share of
    them; a hash of the id thins those that have more, so a rare language is learned from whole.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = stage(labelled.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("_rows")), "langid-sizes")  # one row for each language
    each = max(1, sample_docs // max(1, sizes.count()))
    thinned = labelled.join(F.broadcast(sizes), F.col(lang_col) == F.col("_lang"))
    labelled = thinned.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30) * F.col("_rows") < each).drop("_lang", "_rows")
    counts = stage(word_counts(labelled, text_col, lang_col), "langid")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())  # as many as there are languages
    pieces = load_pieces(vocabulary)
    probs = np.full((len(pieces), len(langs)), 1 / len(pieces))
    spark = docs.sparkSession
    for _ in range(rounds if langs else 0):
        known = spark.sparkContext.broadcast((pieces, langs, probs))  # vocabulary times languages

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            pieces, langs, probs = known.value
            lattice, number = Lattice(pieces), {x: i for i, x in enumerate(langs)}
            total = np.zeros(probs.shape)
            for batch in batches:
                total += expected_counts(lattice, batch.column(1).to_pylist(), np.array([number[x] for x in batch.column(0).to_pylist()], np.int64), np.array(batch.column(2), np.float64), probs)
            at, lang = np.nonzero(total)
            # Whole millionths add up to the same sum in any order.
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(lang, pa.int32()), pa.array(np.rint(total[at, lang] * 1e6).astype(np.int64))], ["piece", "lang", "uses"])

        used = counts.mapInArrow(run, "piece int, lang int, uses long").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        total = np.zeros(probs.shape)
        total[used.piece, used.lang] = used.uses / 1e6
        total += smoothing
        probs = total / total.sum(axis=0)
    return Model(langs, probs)


class _Scorer:
    """Log-probabilities of the words a worker has met; emptied when ``max_bytes`` are reached."""

    def __init__(self, pieces, model: Model, max_bytes: int = 64 << 20):
        self.lattice, self.model, self.find = Lattice(pieces), model, _letters()
        self.limit = max_bytes // (180 + 8 * len(model.langs))  # a word with its place, and its row
        self.row: dict[str, int] = {}
        self.logs = np.zeros((1024, len(model.langs)))

    def learn(self, words: list[str]) -> None:
        if len(self.row) + len(words) > self.limit:
            self.row, self.logs = {}, self.logs[:1024].copy()
        new = [w for w in words if w not in self.row]
        start = len(self.row)
        while start + len(new) > len(self.logs):
            self.logs = np.vstack([self.logs, np.zeros_like(self.logs)])
        self.logs[start : start + len(new)] = word_scores(self.lattice, new, self.model.probs)
        self.row.update(zip(new, range(start, start + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        found = [Counter(self.find(t.lower())) if t else None for t in texts]
        if self.model.langs:
            words = set().union(*(c.keys() for c in found if c))
            if any(w not in self.row for w in words):
                self.learn(list(words))
        for c in found:
            if not c or not self.model.langs:
                yield UNKNOWN, 0.0
                continue
            at = np.fromiter(map(self.row.__getitem__, c), np.int64, len(c))
            logs = np.fromiter(c.values(), np.float64, len(c)) @ self.logs[at]
            best = int(np.argmax(logs))
            yield self.model.langs[best], float(1 / np.exp(logs - logs[best]).sum())


def predict(docs: DataFrame, model: Model, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for each row: the likeliest language and its posterior under even priors."""
    known = docs.sparkSession.sparkContext.broadcast((load_pieces(vocabulary), model))
    key = known._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("langid", key), lambda: _Scorer(*known.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):  # bounds the distinct words held at once
                part = batch.slice(at, 200)
                said = list(scorer.predict(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identified(docs: DataFrame, model: Model, vocabulary: str, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is told with at least ``least_score``, whole and in place."""
    known = docs.sparkSession.sparkContext.broadcast((load_pieces(vocabulary), model))
    key, at_text = known._jbroadcast.id(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("langid", key), lambda: _Scorer(*known.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                said = scorer.predict(part.column(at_text).to_pylist())
                yield part.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in said]))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: a quarter of the ids, by CRC-32 of their decimal form."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))
