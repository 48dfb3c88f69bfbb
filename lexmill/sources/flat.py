"""Flat token and example files: one array a file, as training programs map them into memory.

A stream is ``<split>.bin``, little-endian unsigned ids one after the other; examples are
``<split>.tokens.npy``, ``<split>.mask.npy`` and ``<split>.offsets.npy``. ``meta.json`` names
the kind of ids. Writing goes in two phases: each task writes its rows at the places that
prefix sums give them, into files that nobody reads yet, so a task that runs again writes the
same bytes; the commit compares what arrived with what was announced and renames. Reading
splits files by ranges of bytes.

The folder must be one that the driver and all executors mount; other stores can't write in
the middle of a file, and are refused.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "lexmill_flat"
#: Arrays of a split by kind of file: name behind the split, kind of numbers (None: that of the ids).
STREAM, EXAMPLES = "stream", "examples"
ARRAYS = {STREAM: ((".bin", None),), EXAMPLES: ((".tokens.npy", None), (".mask.npy", "uint8"), (".offsets.npy", "int64"))}


def local_path(path: str) -> str:
    scheme, _, rest = path.partition("://")
    if not rest:
        return path.removeprefix("file:")
    if scheme != "file":
        raise ValueError(f"flat files need a mounted folder, not {path}")
    return rest


def id_kind(vocabulary: int) -> str:
    """The smallest kind of numbers that holds all ids of a vocabulary."""
    return "uint16" if vocabulary <= 65_535 else "uint32"


def _header(kind: str, n: int) -> bytes:
    """What stands before an array of that length in the array format of numpy, always 128 bytes."""
    text = f"{{'descr': '{np.dtype(kind).newbyteorder('<').str}', 'fortran_order': False, 'shape': ({n},), }}"
    return b"\x93NUMPY\x01\x00" + (118).to_bytes(2, "little") + text.ljust(117).encode() + b"\n"


def array_of(path: str, kind: str | None = None) -> np.ndarray:
    """A file as a mapped array; plain ones need their kind of numbers."""
    if path.endswith(".npy"):
        return np.load(path, mmap_mode="r")
    return np.memmap(path, np.dtype(kind).newbyteorder("<"), "r") if os.path.getsize(path) else np.zeros(0, kind)


def meta_of(path: str) -> dict:
    with open(os.path.join(local_path(path), "meta.json"), encoding="utf-8") as f:
        return json.load(f)


@dataclass
class Written(WriterCommitMessage):
    """By split: rows and ids of a task."""

    rows: dict
    ids: dict


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.folder, self.mode, self.kind = local_path(options["path"]), options["mode"], options["kind"]
        self.totals = json.loads(options["totals"])  # by split: rows and ids
        self.own = f".{uuid.uuid4().hex}.part"
        self.meta = json.loads(options.get("meta", "{}"))
        os.makedirs(self.folder, exist_ok=True)

    def _file(self, split: str, suffix: str) -> str:
        return os.path.join(self.folder, split + suffix)

    def _put(self, opened: dict, split: str, suffix: str, at: int, values: np.ndarray) -> None:
        name = self._file(split, suffix) + self.own
        if name not in opened:
            opened[name] = os.open(name, os.O_RDWR | os.O_CREAT)
        before = 128 if suffix.endswith(".npy") else 0
        data = memoryview(np.ascontiguousarray(values)).cast("B")
        done = 0
        while done < len(data):
            done += os.pwrite(opened[name], data[done:], before + at * values.itemsize + done)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        opened: dict[str, int] = {}
        rows, ids = {}, {}
        ids_kind = np.dtype(self.kind).newbyteorder("<")
        try:
            for batch in iterator:
                named = dict(zip(batch.schema.names, batch.columns, strict=True))
                splits, offset = named["split"].to_pylist(), named["offset"].to_numpy()
                lists = named["ids"]
                size = np.diff(lists.offsets.to_numpy())
                begins = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() > np.iinfo(ids_kind).max):
                    raise ValueError(f"an id doesn't fit {self.kind}: {flat.min()} to {flat.max()}")
                # Rows that follow each other in the file are written at once.
                border = [i for i in range(1, len(splits)) if splits[i] != splits[i - 1] or offset[i] != offset[i - 1] + size[i - 1]]
                for a, b in zip([0, *border], [*border, len(splits)], strict=True):
                    if a == b:
                        continue
                    split, values = splits[a], flat[begins[a] : begins[b]]
                    self._put(opened, split, ARRAYS[self.mode][0][0], int(offset[a]), values.astype(ids_kind))
                    if self.mode == EXAMPLES:
                        mask = named["mask"].flatten().to_numpy(zero_copy_only=False)
                        self._put(opened, split, ".mask.npy", int(offset[a]), mask[begins[a] : begins[b]].astype(np.uint8))
                        place = named["place"].to_numpy()
                        for i in range(a, b):  # equal offsets (empty rows) need not have places that follow
                            self._put(opened, split, ".offsets.npy", int(place[i]) + 1, np.array([offset[i] + size[i]], "<i8"))
                    rows[split] = rows.get(split, 0) + b - a
                    ids[split] = ids.get(split, 0) + len(values)
        finally:
            for f in opened.values():
                os.close(f)
        return Written(rows, ids)

    def commit(self, messages: list) -> None:
        for split, (n, size) in self.totals.items():
            got = [sum(getattr(m, what).get(split, 0) for m in messages if m) for what in ("rows", "ids")]
            if got != [n, size]:
                self.abort(messages)
                raise ValueError(f"{split}: {got} rows and ids arrived, {[n, size]} were announced")
        for split, (n, size) in self.totals.items():
            for suffix, kind in ARRAYS[self.mode]:
                kind, count = kind or self.kind, n + 1 if suffix == ".offsets.npy" else size
                before = 128 if suffix.endswith(".npy") else 0
                with open(self._file(split, suffix) + self.own, "r+b" if os.path.exists(self._file(split, suffix) + self.own) else "w+b") as f:
                    f.truncate(before + count * np.dtype(kind).itemsize)
                    f.write(_header(kind, count) if before else b"")
                    f.flush()
                    os.fsync(f.fileno())
        for split in self.totals:
            for suffix, _ in ARRAYS[self.mode]:
                os.replace(self._file(split, suffix) + self.own, self._file(split, suffix))
        made = os.path.join(self.folder, "meta.json" + self.own)
        with open(made, "w", encoding="utf-8") as f:
            json.dump(self.meta | {"dtype": self.kind, "mode": self.mode, "splits": {s: {"rows": n, "ids": size} for s, (n, size) in self.totals.items()}}, f, ensure_ascii=False, indent=2)
        os.replace(made, os.path.join(self.folder, "meta.json"))

    def abort(self, messages: list) -> None:
        for name in os.listdir(self.folder):
            if name.endswith(self.own):
                os.remove(os.path.join(self.folder, name))


@dataclass
class Range(InputPartition):
    split: str
    first: int
    last: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = local_path(options["path"])
        meta = meta_of(self.folder)
        self.kind, self.mode = meta["dtype"], options.get("mode") or meta.get("mode", STREAM)
        wanted = options.get("split")
        suffix = ARRAYS[self.mode][0][0]
        self.splits = [wanted] if wanted else sorted(n.removesuffix(suffix) for n in os.listdir(self.folder) if n.endswith(suffix))
        self.row_ids, self.part_bytes = int(options.get("rowids", 4096)), int(options.get("partbytes", 64 << 20))  # Spark lower-cases names

    def _array(self, split: str, which: int) -> np.ndarray:
        suffix, kind = ARRAYS[self.mode][which]
        return array_of(os.path.join(self.folder, split + suffix), kind or self.kind)

    def partitions(self) -> list[Range]:
        out = []
        for split in self.splits:
            ids = self._array(split, 0)
            if self.mode == STREAM:
                step = max(1, self.part_bytes // ids.itemsize // self.row_ids) * self.row_ids
                n = len(ids)
            else:
                n = len(self._array(split, 2)) - 1
                step = max(1, int(n * self.part_bytes / max(1, len(ids) * (ids.itemsize + 1))))
            out += [Range(split, a, min(a + step, n)) for a in range(0, n, step)]
        return out or [Range("", 0, 0)]  # there must be one

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.last:
            return
        split, ids = partition.split, self._array(partition.split, 0)
        if self.mode == STREAM:
            for a in range(partition.first, partition.last, 256 * self.row_ids):
                b = min(a + 256 * self.row_ids, partition.last)
                begins = np.append(np.arange(a, b, self.row_ids), b) - a
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids[a:b].astype(np.int64), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([split] * len(lists)), pa.array(begins[:-1] + a, pa.int64()), lists], ["split", "first", "ids"])
            return
        mask, offsets = self._array(split, 1), self._array(split, 2)
        at = partition.first
        while at < partition.last:
            # As many examples at once as fit some megabytes, one at least.
            end = max(at + 1, min(partition.last, int(np.searchsorted(offsets, offsets[at] + (1 << 20), "right")) - 1, at + 4096))
            begins = offsets[at : end + 1]
            low, high = int(begins[0]), int(begins[-1])
            local = pa.array(begins - low, pa.int32())
            lists = [pa.ListArray.from_arrays(local, pa.array(x[low:high].astype(t), pt)) for x, t, pt in ((ids, np.int64, pa.int64()), (mask, np.int8, pa.int8()))]
            yield pa.RecordBatch.from_arrays([pa.array([split] * (end - at)), pa.array(np.arange(at, end), pa.int64()), *lists], ["split", "ord", "ids", "mask"])
            at = end


class FlatFiles(DataSource):
    """``lexmill_flat``: options ``path``, ``mode`` (stream or examples), ``split``, ``rowIds`` and ``partBytes`` for reading."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        mode = self.options.get("mode") or meta_of(self.options["path"]).get("mode", STREAM)
        return "split string, first long, ids array<long>" if mode == STREAM else "split string, ord long, ids array<long>, mask array<tinyint>"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FlatFiles)


def _placed(rows: DataFrame, ids: str, ordinal: str, size: str | None) -> tuple[DataFrame, dict]:
    from lexmill.operators.order import running_sum
    from lexmill.storage import stage

    sized = stage(rows.select("split", ordinal, (F.size(ids) if size is None else F.col(size)).cast("long").alias("_n")), "flat-sizes")
    totals = {r["split"]: [r["rows"], r["ids"]] for r in sized.groupBy("split").agg(F.count("*").alias("rows"), F.sum("_n").alias("ids")).collect()}  # a row for each split
    placed = running_sum(running_sum(sized, ordinal, "_n", "offset", by=["split"]), ordinal, F.lit(1), "place", by=["split"])
    return placed.select("split", ordinal, "offset", "place"), totals


def _write(rows: DataFrame, path: str, mode: str, kind: str, totals: dict, meta: dict) -> None:
    register(rows.sparkSession)
    ordered = rows.repartitionByRange("split", "offset", "place").sortWithinPartitions("split", "offset", "place")
    ordered.write.format(FORMAT).options(path=path, mode=mode, kind=kind, totals=json.dumps(totals), meta=json.dumps(meta)).mode("append").save()


def write_stream(docs: DataFrame, path: str, vocabulary: int, ids: str = "ids", ordinal: str = "ord", size: str | None = None, meta: dict | None = None, splits: tuple[str, ...] = ("train", "val")) -> dict:
    """Documents with ``split``, in the order of ``ordinal``, as one file of ids for each split. Returns rows and ids of each."""
    placed, totals = _placed(docs, ids, ordinal, size)
    totals = {s: [0, 0] for s in splits} | totals
    rows = docs.select("split", ordinal, F.col(ids).cast("array<long>").alias("ids")).join(placed, ["split", ordinal])
    _write(rows.select("split", "offset", "place", "ids"), path, STREAM, id_kind(vocabulary), totals, {"vocabulary": vocabulary} | (meta or {}))
    return totals


def write_examples(examples: DataFrame, path: str, vocabulary: int, ids: str = "ids", mask: str = "mask", ordinal: str = "ord", meta: dict | None = None, splits: tuple[str, ...] = ("train", "val")) -> dict:
    """Examples with ``split`` as ids, mask and offsets of each split. Returns rows and ids of each."""
    placed, totals = _placed(examples, ids, ordinal, None)
    totals = {s: [0, 0] for s in splits} | totals
    rows = examples.select("split", ordinal, F.col(ids).cast("array<long>").alias("ids"), F.col(mask).cast("array<tinyint>").alias("mask")).join(placed, ["split", ordinal])
    _write(rows.select("split", "offset", "place", "ids", "mask"), path, EXAMPLES, id_kind(vocabulary), totals, {"vocabulary": vocabulary} | (meta or {}))
    return totals


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """``(split, first, ids)`` of a stream, so many ids a row, or ``(split, ord, ids, mask)`` of examples."""
    register(spark)
    return spark.read.format(FORMAT).options(path=path, **options).load()


def checked(path: str, length: int = 0, batch: int = 1, world: int = 1) -> dict:
    """The files' description, unless they are too small to train from: a stream for blocks of ``length``, examples for a batch on each rank."""
    meta = meta_of(path)
    folder = local_path(path)
    if meta.get("mode", STREAM) == STREAM:
        train, val = (len(array_of(os.path.join(folder, f"{s}.bin"), meta["dtype"])) for s in ("train", "val"))
        if train // length - 1 < 1:
            raise ValueError(f"{train} training tokens are too few for blocks of {length}")
        if val < length + 1:
            raise ValueError(f"{val} validation tokens are too few for blocks of {length}: hold out more documents")
    else:
        n = len(array_of(os.path.join(folder, "train.offsets.npy"))) - 1
        if n // world < batch:
            raise ValueError(f"{n} training examples are too few for batches of {batch} on {world} ranks")
    return meta


def stretches(wanted: DataFrame, path: str, span: int, split: str = "train") -> DataFrame:
    """``wanted`` rows with ``ids``: the ``span`` ids of a stream from ``start``. Only those bytes are read."""
    folder, kind = local_path(path), meta_of(path)["dtype"]
    columns = wanted.columns
    at = columns.index("start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = array_of(os.path.join(folder, f"{split}.bin"), kind)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = pa.array([ids[s : s + span].astype(np.int64) for s in part.column(at).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, found], [*columns, "ids"])

    return wanted.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema) + ", ids array<long>")
