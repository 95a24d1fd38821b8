"""The folder of media: bytes and sidecars written by tasks, overwritten, deleted, verified and cleaned."""

import hashlib

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from siltworks.sources import blobs

NEW = "id string, type string, mime_type string, content binary, source string"


def put(spark, store, rows, now):
    return {r["id"]: r for r in store.put(spark.createDataFrame(rows, NEW), now).collect()}


def names(tmp_path):
    return sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith("."))


def test_put_overwrite_get_delete(spark, tmp_path):
    store = blobs.BlobStore(spark, str(tmp_path))
    assert store.metadata().count() == 0 and store.clean().first()["tmp_removed"] == 0
    first = put(spark, store, [("a/1", "image", "image/png", b"one", "s"), ("b", "video", None, None, "s"), ("c", None, None, b"three", None), ("c", None, None, b"three", None), (None, "image", None, b"x", None)], "2024-01-01")
    assert {(i, r["size_bytes"], r["hash"]) for i, r in first.items()} == {(i, len(x), hashlib.sha256(x).hexdigest()) for i, x in (("a/1", b"one"), ("b", b""), ("c", b"three"))}
    again = put(spark, store, [("b", "image", "image/png", b"new", "s")], "2024-02-02")
    assert (again["b"]["created_at"], again["b"]["last_access"]) == ("2024-01-01", "2024-02-02")
    ids = spark.createDataFrame([("a/1",), ("b",), ("nobody",), ("b",)], "id string")
    assert {(r["id"], bytes(r["content"])) for r in store.get(ids).collect()} == {("a/1", b"one"), ("b", b"new")}
    assert {(r["id"], r["exists"]) for r in store.exists(ids).collect()} == {("a/1", True), ("b", True), ("nobody", False)}
    assert {r["path"] for r in store.files("media/images/").collect()} == {first["a/1"]["storage_path"], again["b"]["storage_path"]}
    assert len(names(tmp_path)) == 6 and all(r["ok"] for r in store.verify().collect())  # the old bytes of b are gone
    assert store.delete(ids) == 2 and {r["id"] for r in store.metadata().collect()} == {"c"} and len(names(tmp_path)) == 2
    assert store.delete(ids) == 0


def test_a_lost_task_leaves_what_clean_removes(spark, tmp_path):
    store = blobs.BlobStore(spark, str(tmp_path))
    kept = put(spark, store, [("k", "image", None, b"kept", None)], "1")["k"]

    # A task that ends between writing and renaming leaves its file under media/tmp.
    (tmp_path / "media/tmp/half").write_bytes(b"ha")
    (tmp_path / "media/images/nobody").write_bytes(b"no sidecar names this")
    put(spark, store, [("w", "image", None, b"gone", None)], "1")
    (tmp_path / put(spark, store, [("w", "image", None, b"gone", None)], "1")["w"]["storage_path"]).unlink()
    (tmp_path / kept["storage_path"]).write_bytes(b"KEPT")
    assert {r["id"]: r["ok"] for r in store.verify().collect()} == {"k": False, "w": False}
    assert store.clean().first().asDict() == {"orphan_metadata_removed": 1, "orphan_blobs_removed": 1, "tmp_removed": 1}
    assert {r["id"] for r in store.metadata().collect()} == {"k"} and store.clean().select(F.expr("orphan_metadata_removed + orphan_blobs_removed + tmp_removed")).first()[0] == 0


def test_files_appear_whole(tmp_path):
    blobs.write_file(str(tmp_path), "media/images/x", b"1" * 100)
    blobs.write_file(str(tmp_path), "media/images/x", b"2" * 10)
    assert blobs.read_file(str(tmp_path), "media/images/x") == b"2" * 10 and list((tmp_path / "media/tmp").iterdir()) == []
    assert blobs.read_file(str(tmp_path), "media/images/y") is None and not blobs.remove_file(str(tmp_path), "media/images/y")


def test_a_store_over_several_folders(spark, tmp_path):
    roots = [tmp_path / x for x in ("one's", "b", "c")]
    store = blobs.BlobStore(spark, backend=blobs.Spread(*map(str, roots)))
    assert store.metadata().count() == 0
    rows = [(f"m{i}", "image", "image/png", f"bytes {i}".encode(), "s") for i in range(30)]
    put(spark, store, rows, "1")
    assert all(len(names(r)) >= 5 for r in roots) and sum(len(names(r)) for r in roots) == 60
    ids = spark.createDataFrame([(r[0],) for r in rows], "id string")
    assert {(r["id"], bytes(r["content"])) for r in store.get(ids).collect()} == {(r[0], r[3]) for r in rows}
    (roots[2] / "media/tmp/half").write_bytes(b"ha")
    (roots[0] / "media/images/nobody").write_bytes(b"not where its name belongs")
    assert all(r["ok"] for r in store.verify().collect()) and store.clean().first()["tmp_removed"] == 1
    assert not (roots[2] / "media/tmp/half").exists() and store.delete(ids) == 30 and store.metadata().count() == 0
    with pytest.raises(ValueError):
        blobs.BlobStore(spark)


def test_files_are_listed_by_a_task_and_dealt_to_few_partitions(spark, tmp_path):
    store = blobs.BlobStore(spark, str(tmp_path))
    put(spark, store, [(f"_m{i}", "image", None, b"x" * i, None) for i in range(300)], "1")
    found = store.metadata()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "BatchScan" not in plan and found.rdd.getNumPartitions() == 4  # one for each 32 files before
    assert {(r["id"], r["size_bytes"]) for r in found.collect()} == {(f"_m{i}", i) for i in range(300)}
    listed = {r["path"]: r for r in store.files("media/images/").collect()}
    assert len(listed) == 300 and listed["media/images/_m7"]["length"] == 7 and listed["media/images/_m7"]["modified"].year >= 2024
    assert store.files("media/nothing/").count() == 0


def test_files_are_written_by_all_tasks(spark, tmp_path):
    store = blobs.BlobStore(spark, str(tmp_path))
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("at")).groupBy("id").agg(F.max("at").alias("at"))
    tasks = store._mapped(rows, lambda backend, media_id, at: str(TaskContext.get().partitionId()), "value string", pa.string())
    assert tasks.select("value").distinct().count() == 4
