"""Stages that resume, and logs whose lines are numbered by commit."""

import threading

import pytest
from pyspark.sql import functions as F

from lexmill.operators import metrics
from lexmill.sources import readers, stages


def flow_of(spark, root, source, calls, factor=10, version=1, fails=False):
    flow = stages.Flow(spark, str(root))
    flow.source("numbers", str(source))

    def doubled(rows):
        calls.append("doubled")
        return rows.select("id", (F.col("id") * 2).alias("x"))

    def scaled(rows, factor):
        calls.append("scaled")
        return rows.withColumn("y", F.col("x") * factor) if not fails else rows.withColumn("y", F.raise_error(F.lit("no")).cast("long"))

    def total(rows, numbers):
        calls.append("total")
        return rows.agg(F.sum("y").alias("s")).crossJoin(numbers.agg(F.count("*").alias("n")))

    flow.stage("doubled", doubled, "numbers")
    flow.stage("scaled", scaled, "doubled", version=version, factor=factor)
    return flow, lambda: flow.stage("total", total, "scaled", "numbers").first()


def test_second_run_does_no_work(spark, tmp_path):
    source, root, calls = tmp_path / "in", tmp_path / "stages", []
    spark.range(10).write.parquet(str(source))
    flow, last = flow_of(spark, root, source, calls)
    assert tuple(last()) == (900, 10) and flow.built == ["doubled", "scaled", "total"]
    flow, last = flow_of(spark, root, source, calls)
    assert tuple(last()) == (900, 10) and flow.built == [] and calls == ["doubled", "scaled", "total"]


def test_changes_rebuild_what_follows(spark, tmp_path):
    source, root, calls = tmp_path / "in", tmp_path / "stages", []
    spark.range(10).write.parquet(str(source))
    flow_of(spark, root, source, calls)[1]()
    flow, last = flow_of(spark, root, source, calls, factor=20)
    assert tuple(last()) == (1800, 10) and flow.built == ["scaled", "total"]
    flow, last = flow_of(spark, root, source, calls, factor=20, version=2)
    assert tuple(last()) == (1800, 10) and flow.built == ["scaled", "total"]
    spark.range(10, 12).write.mode("append").parquet(str(source))  # a further file
    flow, last = flow_of(spark, root, source, calls, factor=20, version=2)
    assert tuple(last()) == (2640, 12) and flow.built == ["doubled", "scaled", "total"]
    assert all(len([p for p in (root / n).iterdir() if p.is_dir()]) == 1 for n in ("doubled", "scaled", "total"))  # replaced tables are gone


def test_failure_keeps_the_last_table(spark, tmp_path):
    source, root, calls = tmp_path / "in", tmp_path / "stages", []
    spark.range(10).write.parquet(str(source))
    flow_of(spark, root, source, calls)[1]()
    with pytest.raises(Exception, match="no"):
        flow_of(spark, root, source, calls, version=2, fails=True)
    flow, last = flow_of(spark, root, source, calls)
    assert tuple(last()) == (900, 10) and flow.built == []
    flow, last = flow_of(spark, root, source, calls, version=2)
    assert tuple(last()) == (900, 10) and flow.built == ["scaled", "total"]
    assert len([p for p in (root / "scaled").iterdir() if p.is_dir()]) == 1  # and so is what the failed run left


def test_empty_tables_and_repeated_names(spark, tmp_path):
    source = tmp_path / "in"
    spark.range(0).write.parquet(str(source))
    flow, last = flow_of(spark, tmp_path / "stages", source, [])
    assert tuple(last()) == (None, 0)
    with pytest.raises(ValueError, match="twice"):
        flow.stage("scaled", lambda rows: rows, "doubled")


def lines(spark, *rows):
    return spark.createDataFrame(rows, "type string, it long, loss double").coalesce(1)


def test_later_append_wins(spark, tmp_path):
    path = str(tmp_path / "log")
    assert readers.append_log(lines(spark, ("train", 1, 9.0), ("train", 2, 8.0), ("train", 2, 7.0)), path) == 0
    assert readers.append_log(lines(spark, ("train", 3, 6.0), ("train", 1, 5.0)), path) == 1
    log = readers.read_log(spark, path)
    assert log.columns == readers.LOG.names
    assert [(r.line_no, r.it, r.loss) for r in log.orderBy("line_no").collect()] == [(0, 1, 9.0), (1, 2, 8.0), (2, 2, 7.0), (3, 3, 6.0), (4, 1, 5.0)]
    assert {r.it: r.loss for r in metrics.last_of_each(log).collect()} == {1: 5.0, 2: 7.0, 3: 6.0}


def test_writers_at_the_same_time_get_numbers_of_their_own(spark, tmp_path):
    path, got = str(tmp_path / "log"), []
    writers = [threading.Thread(target=lambda i=i: got.append(readers.append_log(lines(spark, ("train", i, float(i))), path))) for i in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(got) == [0, 1, 2, 3]
    assert sorted((r.line_no, r.it) for r in readers.read_log(spark, path).collect()) and readers.read_log(spark, path).select("it").distinct().count() == 4


def test_failed_append_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "log")
    readers.append_log(lines(spark, ("train", 1, 9.0)), path)
    with pytest.raises(Exception, match="no"):
        readers.append_log(lines(spark, ("train", 2, 1.0)).withColumn("loss", F.raise_error(F.lit("no")).cast("double")), path)
    assert readers.append_log(lines(spark, ("train", 3, 2.0)), path) == 1
    assert [r.it for r in readers.read_log(spark, path).orderBy("line_no").collect()] == [1, 3]
