"""The bucketed store: what an upsert reads and writes, stopped runs, old versions."""

import os

import pytest
from pyspark.sql import functions as F

from inkproof.operators.store import Store


def ids(spark, *rows):
    return spark.createDataFrame(list(rows), "document_id string, status string, at int")


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_an_upsert_rewrites_its_buckets_alone(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", buckets=16)
    assert s.read() is None
    s.upsert(spark.range(500).select(F.col("id").cast("string").alias("document_id"), F.lit("a").alias("status"), F.lit(1).alias("at")))
    before = files(tmp_path)
    s.upsert(ids(spark, ("7", "b", 2), ("7", "c", 3), ("900", "d", 1)), "at")
    touched = set(s._touched(ids(spark, ("7", "", 0), ("900", "", 0))))
    new = set(files(tmp_path)) - set(before)
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in new} == touched and len(touched) <= 2
    assert all(files(tmp_path)[f] == t for f, t in before.items())
    rows = {r.document_id: r.status for r in s.read().collect()}
    assert len(rows) == 501 and rows["7"] == "c" and rows["900"] == "d" and rows["8"] == "a"
    near = s.read(near=ids(spark, ("7", "", 0)))
    assert len({f.split("bucket=")[1].split("/")[0] for f in near.inputFiles()}) == 1 and near.where("document_id = '7'").count() == 1
    assert s.read(version=1).where("status <> 'a'").count() == 0


def test_order_and_ties(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", buckets=2)
    s.upsert(ids(spark, ("1", "old", 5), ("2", "old", 5), ("3", "old", None), (None, "old", 1)), "at")
    s.upsert(ids(spark, ("1", "early", 4), ("2", "same", 5), ("3", "new", 1), (None, "new", 2)), "at")
    assert {r.document_id: r.status for r in s.read().collect()} == {"1": "old", "2": "same", "3": "new", None: "new"}
    s.upsert(ids(spark, ("1", "last", 0)))
    assert {r.status for r in s.read().where("document_id = '1'").collect()} == {"last"}


def test_a_stopped_run_leaves_the_version_before(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", buckets=4)
    s.upsert(ids(spark, ("1", "a", 1), ("2", "a", 1)))
    stop = F.when(F.col("document_id") == "2", F.raise_error(F.lit("stopped"))).otherwise("b")
    with pytest.raises(Exception, match="stopped"):
        s.upsert(ids(spark, ("1", "x", 2), ("2", "x", 2)).withColumn("status", stop.cast("string")))
    assert {r.status for r in s.read().collect()} == {"a"} and s.versions() == [1]
    s._commit = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))  # all folders are written, the manifest isn't
    with pytest.raises(RuntimeError, match="lost"):
        s.upsert(ids(spark, ("1", "c", 3)))
    again = Store(spark, f"{tmp_path}/s", buckets=4)
    assert {r.status for r in again.read().collect()} == {"a"}
    again.upsert(ids(spark, ("1", "d", 3)))
    assert sorted(r.status for r in again.read().collect()) == ["a", "d"]


def test_vacuum_and_errors(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", ("document_id", "at"), 2)
    for k in range(4):
        s.upsert(ids(spark, ("1", f"v{k}", 1), ("2", f"v{k}", k)))
    assert s.vacuum(1) and s.versions() == [4]
    assert sorted((r.document_id, r.at, r.status) for r in s.read().collect()) == [("1", 1, "v3"), ("2", 0, "v0"), ("2", 1, "v1"), ("2", 2, "v2"), ("2", 3, "v3")]
    assert len({os.path.dirname(f) for f in files(tmp_path)}) <= 2
    with pytest.raises(ValueError):
        s.upsert(ids(spark, ("1", "x", 1)).withColumn("more", F.lit(1)))
    with pytest.raises(ValueError):
        Store(spark, f"{tmp_path}/s", ("document_id", "at"), 3).read()
    s.upsert(ids(spark))
    assert s.versions() == [4]
