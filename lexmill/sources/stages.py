"""Stages that resume: a stage whose inputs, parameters and version are as they were is read, others are rebuilt.

A stage lies in a folder of its own under the flow's root. Its manifest names the table and the
mark it was made under: a digest of the stage's name, version and parameters, and of the marks
of what it reads. So a change anywhere marks all that follow, and nothing else. A table is
written whole before the manifest is put in place by a rename; a run that ends between the two
leaves the stage as it was. One flow at a time may build under a root, others may read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.sources.readers import _java, read_manifest, write_manifest

MANIFEST = "stage.json"


def files_mark(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of all files of an input, whatever their order. Their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    each = [F.xxhash64(F.lit(seed), "path", "length", "modificationTime") for seed in (1, 2)]
    n, size, *marks = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), *[F.bit_xor(m) for m in each]).first()
    return f"{n}:{size}:" + ":".join(map(str, marks))


class Flow:
    """Inputs and stages by name, in the order in which they are declared; ``built`` lists the stages that this run made."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.marks: dict[str, str] = {}
        self.frames: dict[str, DataFrame] = {}
        self.built: list[str] = []

    def _declared(self, name: str) -> None:
        if name in self.frames:
            raise ValueError(f"{name} is declared twice")

    def source(self, name: str, path: str, kind: str = "parquet") -> DataFrame:
        """An input table; it counts as changed when a file of it is."""
        self._declared(name)
        self.marks[name] = files_mark(self.spark, path)
        self.frames[name] = self.spark.read.format(kind).load(path)
        return self.frames[name]

    def stage(self, name: str, build: Callable[..., DataFrame], *reads: str, version: int = 1, **params) -> DataFrame:
        """``build(*tables it reads, **params)``, or the table that is there already.

        ``params`` are JSON values. ``version`` is to be raised when the code of ``build``
        changes what it returns. A failure leaves the stage's last table in place.
        """
        self._declared(name)
        made_of = {"name": name, "version": version, "params": params, "reads": [[r, self.marks[r]] for r in reads]}
        mark = hashlib.sha256(json.dumps(made_of, sort_keys=True).encode()).hexdigest()
        at = f"{self.root}/{name}/{MANIFEST}"
        held = read_manifest(self.spark, at)
        if held is None or held["mark"] != mark:
            table = f"{mark[:16]}-{uuid.uuid4().hex}"
            made = build(*[self.frames[r] for r in reads], **params)
            made.write.parquet(f"{self.root}/{name}/{table}")
            held = {"mark": mark, "table": table, "schema": made.schema.jsonValue(), **made_of}
            write_manifest(held, self.spark, at)
            self.built.append(name)
            self._cleared(name, table)
        self.marks[name] = mark
        self.frames[name] = self.spark.read.schema(T.StructType.fromJson(held["schema"])).parquet(f"{self.root}/{name}/{held['table']}")
        return self.frames[name]

    def _cleared(self, name: str, table: str) -> None:
        """Without the tables that the manifest doesn't name: what it named before, and what failed runs left."""
        folder, fs = _java(self.spark, f"{self.root}/{name}")
        for entry in fs.listStatus(folder):
            if entry.isDirectory() and entry.getPath().getName() != table:
                fs.delete(entry.getPath(), True)
