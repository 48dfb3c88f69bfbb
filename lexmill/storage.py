"""Intermediate tables in the folder that the whole cluster shares.

``stage`` cuts lineage by writing a frame as Parquet and reading it back, so a lost
executor costs a re-read and not a recomputation. The folder is the session's
``spark.checkpoint.dir``; only on a local master where that is unset (tests, a laptop) a
temporary folder stands in for it.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[str, str, SparkSession]] = []
_owner = [""]
_fallback: list[str] = []


def importable(spark: SparkSession) -> None:
    """Let Python workers started by this machine find the package; a cluster has it installed."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def shared_dir(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="lexmill-"))
        root = _fallback[0]
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the session ends or its owner is swept."""
    path = f"{shared_dir(spark)}/lexmill/{label}-{uuid.uuid4().hex}"
    _staged.append((_owner[0], path, spark))
    return path


def stage(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def free(*staged: DataFrame | str) -> None:
    """Delete tables, or new paths, that nothing reads any more: what was made of them is written by now."""
    for item in staged:
        for entry in [x for x in _staged if x[1] == (item if isinstance(item, str) else item.staged_at)]:
            _delete(entry[2], entry[1])
            _staged.remove(entry)


@contextlib.contextmanager
def owned_by(owner: str):
    """Tables staged inside belong to ``owner`` and go with ``sweep(owner)``."""
    before, _owner[0] = _owner[0], owner
    try:
        yield
    finally:
        _owner[0] = before


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sweep(owner: str) -> None:
    for entry in [x for x in _staged if x[0] == owner]:
        _delete(entry[2], entry[1])
        _staged.remove(entry)


@atexit.register
def _sweep_all() -> None:
    for _, path, spark in _staged:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already  # noqa: BLE001
            return
