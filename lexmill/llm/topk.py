"""Exact top-k by inner product with pivot-table elimination.

Vectors become integers ``floor(64 x)``. Pivots are picked far apart from a hashed sample of
rows. Each row's distances to all pivots are computed once and stored with it, in a table that
is ordered by nearest pivot and the distance to it, so neighbours in the table are neighbours
in space. Blocks of the table are cut into small groups with the least and greatest distance
to each pivot. For a query, the largest gap between its own distances and a group's ranges
bounds every distance in the group from below (triangle inequality), hence by
``2 qx = |q|^2 + |x|^2 - |q - x|^2`` every score from above.

A query starts with its k-th best score in the sample as its threshold. Blocks of rows whose
bound lies below the thresholds of a whole block of queries are never sent to it. The others
come in the order of their bounds, and inside a block groups do, until no bound reaches the
k-th score. A block of queries and a share of the blocks of rows meet in one task, so each task
holds one block of each.

How much is left out depends on the data: see ``evaluated_share``.

Defined results: vectors that are null or hold nulls or non-finite components take no part;
repeated rows are each a candidate; all rows with the query's id are its own, and an id that
repeats asks once, with the greatest of its vectors; missing components of shorter vectors
count as 0; components and scores beyond 64 bits take the end of their range, and where sums
leave 53 bits nothing is eliminated; fewer than k other rows give all of them; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexmill.storage import stage

SCALE, PIVOTS, GROUP, BLOCK = 64, 64, 64, 4096
#: Rows from which pivots are picked and first thresholds come.
SAMPLE = 2048
#: Summaries of query blocks that are broadcast at most; with more of them every block meets every other.
SUMMARY_BYTES = 64 << 20
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integer_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v ARRAY<LONG>)``: the rows that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(fine).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    sizes = np.diff(np.array(column.offsets))
    flat = np.array(column.flatten(), np.int64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim), np.int64)
    for i, v in enumerate(column):
        got = np.array(v.as_py(), np.int64)
        out[i, : len(got)] = got
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = x.astype(np.float64), pivots.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def far_apart(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` rows of ``x``, each as far as can be from those before."""
    if not len(x):
        return x
    found, near = [0], _distances(x, x[:1])[:, 0]
    while len(found) < min(k, len(x)):
        found.append(int(near.argmax()))
        near = np.minimum(near, _distances(x, x[found[-1:]])[:, 0])
    return x[found]


def _exact_type(*most: float, dim: int):
    """The fastest type in which inner products of components up to these come out whole."""
    top = most[0] * most[1] * dim
    return np.float32 if top < 2**24 else np.float64 if top < 2**53 else object


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    kind = _exact_type(*(float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)), dim=a.shape[1])
    if kind is object:
        whole = a.astype(object) @ b.astype(object).T
        return np.clip(whole, LOWEST + 1, HIGHEST).astype(np.int64)
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def _bounds(far: np.ndarray, square: np.ndarray, low: np.ndarray, high: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """For queries with distances ``far`` and squared lengths, the greatest score in each group: queries x groups.

    ``far`` may be a pair of least and greatest distances of a block of queries.
    """
    least, most = far if isinstance(far, tuple) else (far, far)
    gap = np.zeros((len(least), len(low)), np.float64)
    for p in range(low.shape[1]):
        np.maximum(gap, np.maximum(low[:, p][None].astype(np.float64) - most[:, p][:, None], least[:, p][:, None].astype(np.float64) - high[:, p][None]), out=gap)
    # Distances are stored in single precision, and scores are whole.
    gap = np.maximum(gap - 3e-7 * max(float(most.max(initial=0)), float(high.max(initial=0))), 0)
    both = square[:, None] + longest[None]
    out = (both - gap * gap) / 2 + 1e-12 * both + 0.5
    return np.where(both < 2**52, out, np.inf)


class _Best:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, far: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.vectors, self.far, self.floor, self.k = ids, vectors, far, floor, k
        self.scores = np.full((len(ids), k), LOWEST)
        self.found = np.full((len(ids), k), HIGHEST)
        self.square = (vectors.astype(np.float64) ** 2).sum(1)
        self.evaluated = 0

    def threshold(self) -> np.ndarray:
        return np.maximum(self.floor, self.scores[:, -1])

    def add(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.evaluated += scores.size
        scores[ids[None, :] == self.ids[at][:, None]] = LOWEST
        better = scores.max(axis=1) >= self.scores[at, -1]
        at, scores = at[better], scores[better]
        if not len(at):
            return
        s = np.hstack([self.scores[at], scores])
        i = np.hstack([self.found[at], np.broadcast_to(ids, scores.shape)])
        order = np.lexsort((i, np.negative(np.maximum(s, LOWEST + 1))), axis=-1)[:, : self.k]
        self.scores[at] = np.take_along_axis(s, order, 1)
        self.found[at] = np.take_along_axis(i, order, 1)

    def meet(self, ids: np.ndarray, x: np.ndarray, near: np.ndarray) -> None:
        """Evaluate a block of rows group by group, for each query in the order of its bounds."""
        cuts, low, high, longest = summary(x, near, GROUP)
        bound = _bounds(self.far, self.square, low, high, longest)
        ranked = np.argsort(-bound, axis=1, kind="stable")
        active = np.arange(len(self.ids))
        for turn in range(len(cuts)):
            group = ranked[active, turn]
            going = bound[active, group] >= self.threshold()[active]
            active, group = active[going], group[going]  # the next bounds are lower still
            if not len(active):
                break
            for g in np.unique(group):
                at = active[group == g]
                span = slice(cuts[g], cuts[g] + GROUP)
                self.add(at, ids[span], _scores(self.vectors[at], x[span]))


def summary(x: np.ndarray, near: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups of ``size`` rows: where they begin, their least and greatest distance to each pivot, their greatest squared length."""
    cuts = np.arange(0, len(x), size)
    return cuts, np.minimum.reduceat(near, cuts), np.maximum.reduceat(near, cuts), np.maximum.reduceat((x.astype(np.float64) ** 2).sum(1), cuts)


_PACKED = "qb long, part int, role int, turn double, ids binary, vectors binary, far binary, floor binary"


def _packed(qb: int, part: int, role: int, turn: float, ids, x, far, floor) -> pa.RecordBatch:
    binary = [pa.array([a.tobytes()], pa.binary()) for a in (ids, x, far, floor)]
    return pa.RecordBatch.from_arrays([pa.array([qb], pa.int64()), pa.array([part], pa.int32()), pa.array([role], pa.int32()), pa.array([turn], pa.float64()), *binary], ["qb", "part", "role", "turn", "ids", "vectors", "far", "floor"])


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, pivots: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the pivot table in their order, a block at a time: ids, vectors, distances."""
    held: list[pa.RecordBatch] = []

    def made():
        rows = pa.Table.from_batches(held).combine_chunks()
        x = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.int64).reshape(-1, dim)
        return np.array(rows.column(0), np.int64), x, np.frombuffer(b"".join(rows.column(2).to_pylist()), np.float32).reshape(-1, pivots)

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, BLOCK - sum(b.num_rows for b in held))
            held.append(part)
            at += part.num_rows
            if sum(b.num_rows for b in held) == BLOCK:
                yield made()
                held.clear()
    if held:
        yield made()


def _search(rows: DataFrame, k: int, every: int, id_col: str, vec_col: str) -> tuple[DataFrame, int, int]:
    """``(query_id, r, id, score)``, k rows of each part of the table; r is -1 for counts of evaluated pairs. Then the numbers of queries and rows."""
    spark = rows.sparkSession
    vectors = stage(integer_vectors(rows, id_col, vec_col), "vectors")
    n, dim = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    dim = dim or 1
    # A fixed number of rows.
    chosen = vectors.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).collect()
    sample = _matrix(pa.array([r.v for r in chosen], pa.list_(pa.int64())), dim)
    sample_ids = np.array([r.id for r in chosen], np.int64)
    pivots = far_apart(sample, PIVOTS)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), dim)
            far = _distances(x, pivots)
            near = far.argmin(axis=1)
            binary = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), binary(x), binary(far), pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(x)), near])], ["id", "vector", "far", "near", "d"])

    schema = "id long, vector binary, far binary, near int, d float"
    order = ["near", "d", "id"]
    table = stage(vectors.mapInArrow(measured, schema).repartitionByRange(*order).sortWithinPartitions(*order), "pivot-table")
    asking = vectors.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.max("v").alias("v"))
    asked = asking.count()
    query_blocks = -(-asked // BLOCK)
    parts = max(1, min(64, n // (4 * BLOCK)))

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for number, (ids, x, far) in enumerate(_blocks(batches, dim, len(pivots))):
            scores = _scores(x, sample)
            scores[sample_ids[None] == ids[:, None]] = LOWEST
            floor = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), LOWEST)
            yield _packed(first + number, 0, 0, 0.0, ids, x, far, floor)

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for qb, x, far, floor in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, far = np.frombuffer(x, np.int64).reshape(-1, dim), np.frombuffer(far, np.float32).reshape(-1, len(pivots))
                made = ([qb], [far.min(axis=0).tobytes()], [far.max(axis=0).tobytes()], [float((x.astype(np.float64) ** 2).sum(1).max())], [int(np.frombuffer(floor, np.int64).min())])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, (pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.int64()), strict=True)], ["qb", "least", "most", "square", "floor"])

    queries = asking.mapInArrow(measured, schema).repartitionByRange(max(1, query_blocks), *order).sortWithinPartitions(*order)
    queries = stage(queries.select("id", "vector", "far").mapInArrow(asks, _PACKED), "query-blocks")
    shared = None
    if query_blocks * (8 * len(pivots) + 64) <= SUMMARY_BYTES:
        about = queries.select("qb", "vectors", "far", "floor").mapInArrow(summaries, "qb long, least binary, most binary, square double, floor long").collect()  # checked above
        far = lambda name: np.array([np.frombuffer(r[name], np.float32) for r in about])
        columns = (np.array([r.qb for r in about]), far("least"), far("most"), np.array([r.square for r in about]), np.array([r["floor"] for r in about])) if about else None
        shared = spark.sparkContext.broadcast(columns)
    numbers = [r.qb for r in queries.select("qb").collect()]  # one for each block of queries

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId()
        none = np.empty(0, np.int64)
        for ids, x, far in _blocks(batches, dim, len(pivots)):
            turn += 1
            if shared is None:
                meets = [(qb, 0.0) for qb in numbers]
            elif shared.value is None:
                return
            else:
                qb, least, most, square, floor = shared.value
                _, low, high, longest = summary(x, far, len(x))
                bound = _bounds((least, most), square, low, high, longest)[:, 0]
                meets = [(qb[i], -bound[i]) for i in np.flatnonzero(bound >= floor)]
            for q, place in meets:
                yield _packed(int(q), turn % parts, 1, float(place), ids, x, far, none)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answers(best):
            rank = np.broadcast_to(np.arange(k), best.scores.shape)
            real = best.scores > LOWEST
            names = ["query_id", "r", "id", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(best.ids[:, None], real.shape)[real]), pa.array(rank[real].astype(np.int32)), pa.array(best.found[real]), pa.array(best.scores[real])], names)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([-1], pa.int32()), pa.array([None], pa.int64()), pa.array([best.evaluated], pa.int64())], names)

        at, best = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                qb, part, role, turn, ids, x, far, floor = (c[i].as_py() for c in batch.columns)
                ids, far = np.frombuffer(ids, np.int64), np.frombuffer(far, np.float32).reshape(-1, len(pivots))
                x = np.frombuffer(x, np.int64).reshape(len(ids), dim)
                if role == 0:
                    if best is not None:
                        yield from answers(best)
                    at, best = (qb, part), _Best(ids, x, far, np.frombuffer(floor, np.int64), k)
                elif at == (qb, part) and (turn == 0.0 or -turn >= best.threshold().min()):
                    best.meet(ids, x, far)
        if best is not None:
            yield from answers(best)

    every_part = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cells = every_part.unionByName(table.select("id", "vector", "far").mapInArrow(sent, _PACKED))
    found = cells.repartition("qb", "part").sortWithinPartitions("qb", "part", "role", "turn").mapInArrow(search, "query_id long, r int, id long, score long")
    return found, asked, n


def top_k(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: for each id divisible by ``every``, its best rows of other ids."""
    found, _, _ = _search(rows, k, every, id_col, vec_col)
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")  # k rows from each part
    best = found.where("r >= 0").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def evaluated_share(rows: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """Of all pairs of a query and a row the share whose score was computed; the others were eliminated by bounds."""
    found, asked, n = _search(rows, k, every, id_col, vec_col)
    return (found.where("r = -1").agg(F.sum("score")).first()[0] or 0) / max(1, asked * n)
