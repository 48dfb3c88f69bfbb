"""Near-duplicate classes by HyperMinHash sketches, confirmed on whole shingle sets.

1. Each text becomes its set of 5-word shingle hashes and a sketch: for each of 192 buckets the
   leading-zero count and ten mantissa bits of the bucket's least hash. Empty buckets borrow
   from another bucket by a fixed probe order, so small sets keep the Jaccard property.
2. Equal sets are one class, found by a 128-bit digest; one representative goes on.
3. Bands of registers (six at 85 %, five at 80 %) give candidate buckets. First each member meets its bucket's least
   member: a star, as long as the bucket. Pairs pass the size bound, then the
   collision-corrected Jaccard estimate, then exact verification on both whole texts.
4. Components of the confirmed links. Buckets that still hold several components are gone
   through again in cells of bounded size: every pair of members whose components differ. The
   sketches meet first, each sent to at most 32 cells of its bucket while a bucket has up to a
   million members; texts are fetched only for members that have a partner by them.
5. Components again: each document gets the smallest id it reaches.

Step 4 covers every pair that shares a bucket, so links are lost only where no band agrees
(under 1e-6 at the threshold) or the estimate falls four and a half deviations short; how many
registers are independent of each other, which that deviation depends on, follows from the
size of the smaller set (``Bound.least_estimate``). The README has measured recall by size.

Defined results: null and empty texts have an empty set, stay alone and are kept; rows whose
id is null stay alone (null component) and are kept; rows that repeat an id are one document
with several texts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.graph import components
from lexmill.llm.worker import kept
from lexmill.storage import stage

WIDTH, THRESHOLD = 5, 85  # words in a shingle; percent
BUCKETS = 192
VALUE_BITS, MANTISSA = 44, 10
CELL = 400  # members of a bucket that meet as many others in one group: with their texts at most, with their sketches at least
CHUNKS, LARGEST = 16, 1 << 16  # chunks that a bucket's sketches are cut into at most, while none has more members than LARGEST
SHARE = 64  # partners that one representative's text is sent along with


@dataclass(frozen=True)
class Bound:
    """What follows from a threshold in percent."""

    percent: int = THRESHOLD

    def __post_init__(self):
        if not 50 <= self.percent < 100:
            raise ValueError(f"threshold must be 50 to 99 percent, not {self.percent}")

    @functools.cached_property
    def rows(self) -> int:
        """Registers in a band: as many as leave a pair at the threshold in no common bucket with a chance under 1e-6."""
        at = self.percent / 100
        return max(r for r in range(1, BUCKETS) if r == 1 or (1 - at**r) ** (BUCKETS // r) < 1e-6)

    @functools.cached_property
    def bands(self) -> int:
        return BUCKETS // self.rows

    def least_estimate(self, sizes: np.ndarray) -> np.ndarray:
        """Four and a half standard deviations of the estimate under the threshold, for sets of these sizes.

        Small sets leave buckets empty, which borrow: only the others say something of their own.
        """
        at, own = self.percent / 100, BUCKETS * -np.expm1(-np.maximum(sizes, 1) / BUCKETS)
        return at - 4.5 * np.sqrt(at * (1 - at) / own)

    def cut(self, regs: np.ndarray) -> np.ndarray:
        """Sketches as bands; registers that fill no band are left to the estimate."""
        return regs[..., : self.bands * self.rows].reshape(*regs.shape[:-1], self.bands, self.rows)


_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


#: For each bucket, all buckets in the order in which it looks for a value; itself first.
_PROBES = np.argsort(
    np.where(np.eye(BUCKETS, dtype=bool), _U(0), _scramble(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + _U(1)).reshape(BUCKETS, BUCKETS)), axis=1, kind="stable"
)


class _Words(dict):
    """Hashes of the words a worker has met; emptied when ``max_bytes`` are reached."""

    def __init__(self, max_bytes: int = 64 << 20):
        super().__init__()
        self.max_bytes, self.bytes = max_bytes, 0

    def __missing__(self, word: bytes) -> int:
        self.bytes += 210 + len(word)
        if self.bytes > self.max_bytes:
            self.clear()
            self.bytes = 0
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of a shorter text, of its whole sequence."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(kept("words", _Words).__getitem__, words), np.uint64, len(words))
    if len(h) < WIDTH:
        total = (h * _FACTORS[: len(h)]).sum(dtype=np.uint64, keepdims=True) + _U(len(h))
        return _scramble(total)
    n = len(h) - WIDTH + 1
    total = np.zeros(n, np.uint64)
    for i in range(WIDTH):
        total += _scramble(h[i : i + n] + _FACTORS[i]) * _FACTORS[i]
    return np.unique(_scramble(total))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set: ``leading zeros << 10 | mantissa`` for each bucket."""
    bucket = (((hashes >> _U(VALUE_BITS)) * _U(BUCKETS)) >> _U(64 - VALUE_BITS)).astype(np.int64)
    value = hashes & _U((1 << VALUE_BITS) - 1)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))  # hashes are sorted, so are buckets
    least = np.minimum.reduceat(value, starts).astype(np.float64)
    part, power = np.frexp(least)
    mantissa = np.clip((part * 2 - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.uint16)
    regs = np.zeros(BUCKETS, np.uint16)
    regs[bucket[starts]] = ((VALUE_BITS - power).astype(np.uint16) << np.uint16(MANTISSA)) | mantissa
    if len(starts) < BUCKETS:
        full = np.zeros(BUCKETS, bool)
        full[bucket[starts]] = True
        empty = np.flatnonzero(~full)
        probes = _PROBES[empty]
        regs[empty] = regs[probes[np.arange(len(empty)), full[probes].argmax(axis=1)]]
    return regs


@functools.lru_cache(4096)
def _chance(a: int, b: int) -> float:
    """Probability that the registers of two disjoint sets agree; a, b: quarter powers of two of their bucket loads."""
    edges = np.array([0.0, *((1 + m / 1024) * 2.0 ** (e - 1) for e in range(-VALUE_BITS + MANTISSA + 1, 1) for m in range(1024)), 1.0])
    p = [-np.diff(np.exp(2 ** (x / 4) * np.log1p(-np.minimum(edges, 1 - 1e-15)))) for x in (a, b)]
    return float((p[0] * p[1]).sum())


def estimates(one: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates of pairs of sketches of sets of n and m shingles, corrected for registers that agree by chance."""
    agree = (one == other).mean(axis=1)
    loads = [np.round(4 * np.log2(np.maximum(1.0, np.broadcast_to(x, agree.shape) / BUCKETS))).astype(np.int64) for x in (n, m)]
    load, place = np.unique(np.minimum(*loads) << 32 | np.maximum(*loads), return_inverse=True)
    chance = np.array([_chance(int(x >> 32), int(x & 0xFFFFFFFF)) for x in load])[place] if len(load) else np.empty(0)
    return (agree - chance) / (1 - chance)


def plausible(one: np.ndarray, n: np.ndarray, other: np.ndarray, m: np.ndarray, bound: Bound) -> np.ndarray:
    """Pairs that the size bound and the estimate leave: no set shares more than the smaller holds. Sketches and sizes broadcast."""
    least, most = np.minimum(n, m), np.maximum(n, m)
    out = np.asarray(100 * least >= bound.percent * most)
    at = np.flatnonzero(out)
    if len(at):
        pick = lambda x, width: np.broadcast_to(x, (len(out), *width))[at]
        found = estimates(pick(one, (BUCKETS,)), pick(n, ()), pick(other, (BUCKETS,)), pick(m, ()))
        out[at] = found >= bound.least_estimate(least[at])
    return out


class _Groups:
    """Which components a cell's links have joined so far."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x


def linked(a: np.ndarray, b: np.ndarray, bound: Bound) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= bound.percent * (len(a) + len(b) - both)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n_shingles, digest, regs)`` of each row; digest and regs are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, digest, regs = [], [], []
                for text in part.column(1):
                    h = shingles(text.as_py())
                    n.append(len(h))
                    digest.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                    regs.append(registers(h).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(regs, pa.binary())], ["id", "n_shingles", "digest", "regs"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, n_shingles long, digest binary, regs binary")


def band_members(reps: DataFrame, bound: Bound) -> DataFrame:
    """``(key, first, id)`` for each member of each band bucket but its least, ``first``."""
    n_bands, n_rows = bound.bands, bound.rows

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bands = bound.cut(_regs(batch.column(1))).astype(np.uint64)
            key = np.broadcast_to(np.arange(n_bands, dtype=np.uint64) * _FACTORS[0], bands.shape[:2]).copy()
            for i in range(n_rows):
                key = _scramble(key + bands[:, :, i] * _FACTORS[1] + _U(i))
            key = key * _U(256) + np.arange(n_bands, dtype=np.uint64)  # the band can be read from the key
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64).ravel()), pa.array(np.repeat(np.array(batch.column(0)), n_bands))], ["key", "id"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_first = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, id_ = np.array(batch.column(0)), np.array(batch.column(1))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = key[0] != last_key
            first = id_[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            if not new[0]:
                upto = np.argmax(new) if new.any() else len(new)
                first[:upto] = last_first
            last_key, last_first = key[-1], first[-1]
            more = ~new & (id_ != first)
            yield pa.RecordBatch.from_arrays([pa.array(key[more]), pa.array(first[more]), pa.array(id_[more])], ["key", "first", "id"])

    bands = reps.select("id", "regs").mapInArrow(keys, "key long, id long")
    return bands.repartition("key").sortWithinPartitions("key", "id").mapInArrow(runs, "key long, first long, id long")


def estimated(pairs: DataFrame, reps: DataFrame, bound: Bound) -> DataFrame:
    """Pairs ``(a, b)`` that the sizes and the sketches leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = np.array(batch.column(2)), np.array(batch.column(4))
            regs_a, regs_b = _regs(batch.column(3)), _regs(batch.column(5))
            ok = pa.array(plausible(regs_a, n, regs_b, m, bound))
            yield pa.RecordBatch.from_arrays([x.filter(ok) for x in (batch.column(0), batch.column(1))], ["a", "b"])

    one = reps.select(F.col("id").alias("a"), F.col("n_shingles").alias("n"), F.col("regs").alias("ra"))
    two = reps.select(F.col("id").alias("b"), F.col("n_shingles").alias("m"), F.col("regs").alias("rb"))
    fits = 100 * F.least("n", "m") >= bound.percent * F.greatest("n", "m")
    # Sizes first: they are small, and drop most pairs before sketches are sent.
    pairs = pairs.join(one.select("a", "n"), "a").join(two.select("b", "m"), "b").where(fits).select("a", "b")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "ra", "m", "rb").mapInArrow(run, "a long, b long")


def needed_texts(need: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` of the given ids."""
    need = stage(need, "need")
    if need.count() <= 1_000_000:  # 8 MB of ids; beyond it the join is shuffled
        need = F.broadcast(need)
    return stage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(need, "id", "left_semi"), "texts")


def confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, bound: Bound) -> DataFrame:
    """Pairs whose whole sets are similar enough. A text that many pairs share is sent once for each ``SHARE`` partners."""
    texts = needed_texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, id_col, text_col)
    degree = stage(pairs.groupBy("a").agg(F.count("*").alias("d")), "degree")
    salted = pairs.join(degree, "a").select("a", "b", F.expr(f"cast(pmod(xxhash64(b), d div {SHARE} + 1) as int)").alias("salt"))
    heads = degree.select("a", F.explode(F.expr(f"sequence(0, cast(d div {SHARE} as int))")).alias("salt"))
    left = heads.join(texts.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    right = salted.join(texts.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in batches:
            a, salt, b, text = (batch.column(i) for i in range(4))
            out = ([], [])
            for i in range(batch.num_rows):
                key, other = (a[i].as_py(), salt[i].as_py()), b[i].as_py()
                if key != at:
                    at, sets = key, []
                own = shingles(text[i].as_py())
                if other is None:
                    sets.append(own)  # more than one only where rows repeat an id
                elif any(linked(x, own, bound) for x in sets):
                    out[0].append(key[0])
                    out[1].append(other)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    mixed = left.unionByName(right).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return mixed.mapInArrow(run, "a long, b long")


def sketch_chunks(n: str) -> str:
    """Into how many chunks the sketches of n members are cut: few, so that what is sent grows with the bucket and not its square."""
    return f"greatest(least({n} div {CELL} + 1, {CHUNKS}), {n} div {LARGEST} + 1)"


def text_chunks(n: str) -> str:
    return f"{n} div {CELL} + 1"


def dealt(asking: DataFrame, met: DataFrame, keep: list[str], chunks: Callable[[str], str], hashed: str, u: str = "u", v: str = "v") -> DataFrame:
    """Cells (u, v): chunk u of the rows that ask, of which there are ``others``, with chunk v of those they meet, of which there are ``all``."""
    own = lambda n: F.expr(f"cast(pmod({hashed}, {chunks(n)}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, cast({chunks(n)} as int) - 1)"))
    asking = asking.select(*keep, F.lit(True).alias("asks"), own("others").alias(u), every("`all`").alias(v))
    return asking.unionByName(met.select(*keep, F.lit(False).alias("asks"), every("others").alias(u), own("`all`").alias(v)))


def rest_links(members: DataFrame, reps: DataFrame, labels: DataFrame, docs: DataFrame, id_col: str, text_col: str, bound: Bound) -> DataFrame:
    """``(a, b)``: links between members of one bucket that lie in different components so far.

    A bucket's largest component need not meet itself: the other members (``minor``) are cut
    into chunks, and each chunk meets chunks of all members in a cell. Sketches meet first and
    leave the members that have a partner by them; these meet again with their texts, so
    pairs are refuted where they meet and only links leave. A pair is looked at in the first
    band in which it agrees, and not where the cell's links have joined it already.
    """
    rows = members.select("key", "id").unionByName(members.select("key", F.col("first").alias("id")).distinct())
    rows = rows.join(labels, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    sizes = stage(rows.groupBy("key", "comp").agg(F.count("*").alias("n")), "bucket-components")
    top = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("comps")).where("comps > 1")
    top = stage(top.select("key", F.col("top.comp").alias("major"), "all", (F.col("all") - F.col("top.n")).alias("others")), "mixed-buckets")
    rows = stage(rows.join(top, "key").withColumn("minor", F.col("comp") != F.col("major")).withColumn("h", F.xxhash64("id")), "mixed-members")
    order = ["key", "u", "v"]
    cells = dealt(rows.where("minor"), rows, ["key", "id", "comp"], sketch_chunks, "h").join(reps.select("id", "n_shingles", "regs"), "id").select(*order, "asks", "id", "comp", "n_shingles", "regs")

    def hits(key: int, packed: list[np.ndarray], bands: np.ndarray, comp: int, id_: int, n: int, regs: np.ndarray) -> np.ndarray:
        """Of a chunk of minor members those that a member may be linked with, and meets here first."""
        own, at = bound.cut(regs), key % 256
        fits = 100 * np.minimum(packed[2], n) >= bound.percent * np.maximum(packed[2], n)
        found = np.flatnonzero(fits & (packed[1] != comp) & (packed[0] != id_))
        found = found[(bands[found, at] == own[at]).all(axis=1)]
        found = found[~(bands[found, :at] == own[:at]).all(axis=2).any(axis=1)]
        return found[plausible(packed[3][found], packed[2][found], regs, np.full(len(found), n), bound)]

    def partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of cells that have a partner by their sketches."""
        at = packed = bands = None
        asking: list[tuple] = []
        wanted: set[int] = set()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*order, "asks", "id", "comp", "n_shingles", "regs"])

        for batch in batches:
            if not batch.num_rows:
                continue
            out, sketched = [], _regs(batch.column(7))
            for i, row in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if row[:3] != at:
                    out += [asking[j] for j in sorted(wanted)]
                    at, asking, packed, wanted = row[:3], [], None, set()
                if row[3]:
                    asking.append(row)
                elif asking:
                    if packed is None:
                        packed = [np.array([r[c] for r in asking]) for c in (4, 5, 6)]
                        packed.append(np.frombuffer(b"".join(r[7] for r in asking), np.uint16).reshape(-1, BUCKETS))
                        bands = bound.cut(packed[3])
                    found = hits(row[0], packed, bands, row[5], row[4], row[6], sketched[i])
                    if len(found):
                        wanted.update(found.tolist())
                        out.append(row)
            yield made(out)
        yield made([asking[j] for j in sorted(wanted)])

    schema = "key long, u int, v int, asks boolean, id long, comp long, n_shingles long, regs binary"
    met = stage(cells.repartition(*order).sortWithinPartitions(*order, F.col("asks").desc()).mapInArrow(partnered, schema), "partnered")
    texts = needed_texts(met.select("id").distinct(), docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = asking = texts_ = sets = packed = bands = groups = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True))
            asks, ids, comps, n = (batch.column(i).to_pylist() for i in (5, 6, 7, 8))
            regs, text = _regs(batch.column(9)), batch.column(10)
            out = ([], [])
            for i, key in enumerate(keys):
                if key != at:
                    at, asking, texts_, packed, sets, groups = key, ([], [], [], []), [], None, {}, _Groups()
                if asks[i]:  # sorted first in the cell; at most about a chunk of them
                    for held, x in zip(asking, (ids[i], comps[i], n[i], regs[i].copy()), strict=True):
                        held.append(x)
                    texts_.append(text[i].as_py())
                    continue
                if not asking[0]:
                    continue
                if packed is None:
                    packed = [np.array(x) for x in asking]
                    bands = bound.cut(packed[3])
                own = None
                for j in hits(key[0], packed, bands, comps[i], ids[i], n[i], regs[i]).tolist():
                    one, two = groups.top(comps[i]), groups.top(asking[1][j])
                    if one == two:
                        continue
                    own = shingles(text[i].as_py()) if own is None else own
                    if j not in sets:
                        sets[j] = shingles(texts_[j])
                    if linked(own, sets[j], bound):
                        groups.up[max(one, two)] = min(one, two)
                        out[0].append(min(asking[0][j], ids[i]))
                        out[1].append(max(asking[0][j], ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    # What is left of a cell meets in smaller ones, since texts are held there.
    held = met.groupBy(*order).agg(F.count_if("asks").alias("others"), F.count_if(~F.col("asks")).alias("all"))
    left = met.join(held, order).withColumn("h", F.xxhash64(F.lit(1), "id"))
    small = [*order, "s", "t"]
    again = dealt(left.where("asks"), left.where("not asks"), [*order, "id", "comp", "n_shingles", "regs"], text_chunks, "h", "s", "t").join(texts, "id")
    again = again.select(*small, "asks", "id", "comp", "n_shingles", "regs", "text").repartition(*small).sortWithinPartitions(*small, F.col("asks").desc())
    return again.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for each row of ``docs``; texts link at a Jaccard of ``threshold`` percent."""
    bound = Bound(threshold)
    sketched = stage(sketches(docs, id_col, text_col), "sketches")
    known = sketched.where("digest is not null and id is not null")
    # One row of each equal set goes on; its registers and size are those of the whole class.
    classes = stage(known.groupBy("digest").agg(F.min("id").alias("id")), "classes")
    reps = stage(known.join(classes, ["digest", "id"], "left_semi").select("id", "n_shingles", "digest", "regs").dropDuplicates(["id", "digest"]).drop("digest"), "reps")
    members = stage(band_members(reps, bound), "bands")
    stars = stage(members.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = stage(confirmed(stage(estimated(stars, reps, bound), "star-pairs"), docs, id_col, text_col, bound), "links")
    labels = components(links)
    more = stage(rest_links(members, reps, labels, docs, id_col, text_col, bound), "rest-links")
    # Rows that repeat an id with different texts join their classes.
    same = known.join(classes.withColumnRenamed("id", "a"), "digest").where("id <> a").select("a", F.col("id").alias("b"), "digest")
    own = known.groupBy("id").agg(F.countDistinct("digest").alias("k")).where("k > 1").select(F.col("id").alias("b"))
    same = same.join(own, "b", "left_semi").select("a", "b")
    labels = components(links.unionByName(more).unionByName(same))
    labels = labels.withColumnRenamed("id", "rep")
    joined = (
        sketched.select("id", "n_shingles", "digest")
        .join(classes.withColumnRenamed("id", "rep"), "digest", "left")
        .join(labels, "rep", "left")
        .withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")))
    )
    return joined.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
