"""Paged passes, run control of exports, sessions and the event log."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.plans import export, passes
from siltworks.sources.sessions import EventLog, Sessions, last_events
from siltworks.sources.store import Store
from siltworks.streaming import pipelines
from tests.test_export import resources, row


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def run(coordinator, path, **more):
    given = {"request_id": "r1", "target": "json", "blobs": None, "now": "2024-08-01T00:00:00.000Z", "page_rows": 3}
    return coordinator.run(path=str(path), **{**given, **more})


def ids(path):
    return [json.loads(x)["resourceId"] for x in path.read_text().splitlines()]


def test_pages_cover_every_key_once(spark):
    rows = spark.createDataFrame([(f"{i * 7 % 50:03d}",) for i in range(50)] + [("020",), (None,)], "id string")
    ends = passes.page_ends(rows, page_rows=9)
    pages = [[r[0] for r in rows.where(passes.within("id", ends, p)).collect()] for p in range(len(ends) + 1)]
    assert len(pages) > 3 and sorted(map(str, sum(pages, []))) == sorted(str(r[0]) for r in rows.collect())
    assert passes.page_ends(rows.limit(0)) == []


def test_interrupted_export_goes_on_where_it_was(spark, store, tmp_path, monkeypatch):
    store.save("resources", resources(spark, *[row(f"k{i}") for i in range(9)]))
    coordinator, out, pages = export.Coordinator(store), tmp_path / "x.ndjson", []
    real = export.json_lines

    def lines(items, inclusion):
        pages.append([r["id"] for r in items.select("id").collect()])
        if len(pages) == 2:
            raise RuntimeError("lost")
        return real(items, inclusion)

    monkeypatch.setattr(export, "json_lines", lines)
    with pytest.raises(RuntimeError, match="lost"):
        run(coordinator, out, incremental=True)
    assert not out.exists() and coordinator.progress()["done"] is False and coordinator.progress()["pages_done"] == 1 and coordinator.manifest("json") is None
    store.save("resources", resources(spark, row("later")))
    result = coordinator.resume(str(out), None, "unused")
    assert result.exported == 9 and ids(out) == [f"k{i}" for i in range(9)]
    assert pages[1] == pages[2] and sorted(sum(pages[2:], pages[0])) == [f"k{i}" for i in range(9)]
    assert coordinator.progress()["done"] and coordinator.manifest("json")["last_exported_at"] == "2024-08-01T00:00:00.000Z"
    assert coordinator.resume(str(out), None, "unused") is None


def test_cancel_in_a_job_clears_everything(spark, store, tmp_path, monkeypatch):
    store.save("resources", resources(spark, *[row(f"k{i}") for i in range(9)]))
    coordinator, out = export.Coordinator(store), tmp_path / "x.ndjson"

    def stopped(lines, path):
        (tmp_path / "x.ndjson.partial").write_text("half")
        coordinator.cancel("r1")
        raise OSError("the job was cancelled")

    monkeypatch.setattr(export, "write_single_ndjson", stopped)
    with pytest.raises(export.Cancelled):
        run(coordinator, out, incremental=True)
    assert coordinator.progress() is None and not out.exists() and not (tmp_path / "x.ndjson.partial").exists()
    assert store.get_state("export_request") is None and store.get_state("export_cancelled:r1") is None and coordinator.manifest("json") is None
    monkeypatch.undo()
    assert run(coordinator, out).exported == 9  # the same request may run again


def test_unknown_target_and_second_run(store, tmp_path):
    coordinator = export.Coordinator(store)
    with pytest.raises(KeyError):
        run(coordinator, tmp_path / "x", target="pdf")
    coordinator.running = True
    with pytest.raises(RuntimeError):
        run(coordinator, tmp_path / "x")


def test_progress_without_a_request_is_cleared(store, tmp_path):
    store.put_state("export_progress", json.dumps({"request_id": "r", "target": "json", "done": False}))
    coordinator = export.Coordinator(store)
    assert coordinator.resume(str(tmp_path / "x"), None, "t") is None and coordinator.progress() is None


def test_fetched_bytes_come_before_stored_ones(spark, store, tmp_path):
    store.save("resources", resources(spark, row("a", media=("m", "n"))))
    facts = [(i, "image", "m", 1, "h", "p", "complete", "t", "t", None) for i in ("m", "n")]
    store.save("media_metadata", spark.createDataFrame(facts, schema.MEDIA_METADATA))
    bytes_of = lambda *rows: spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "media_id string, content binary")
    result = run(export.Coordinator(store), tmp_path / "x.zip", target="markdown", blobs=bytes_of(("m", b"stored"), ("n", b"stored")), direct=bytes_of(("m", b"fetched")))
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert (z.read("media/m"), z.read("media/n"), result.media_included) == (b"fetched", b"stored", 2)


def test_sessions_embed_counters_and_keep_history(spark, store):
    kept = Sessions(store)
    assert kept.update("t") is None and kept.current() is None
    assert kept.init("s0", "t0")["status"] == "idle" and kept.init("s9", "t1")["id"] == "s0"
    kept.start("s1", "t2")
    event = lambda n, kind, at: (n, "s1", at, kind, 1.0, "{}")
    ddl = "seq long, session_id string, ts string, event_type string, value double, payload string"
    kept.log.append(spark.createDataFrame([event(1, "discovered", "2024-01-01 10:00:00"), event(2, "extracted", "2024-01-02 10:00:00")], ddl))
    kept.log.append(spark.createDataFrame([event(3, "discovered", "2024-01-02 10:00:00")], ddl))
    now = kept.sync(4, "t3")
    assert (now["queue_depth"], now["status"], json.loads(now["metrics"])["discovered"]) == (4, "running", 2)
    assert {r["id"]: r["status"] for r in kept.history().collect()} == {"s0": "idle", "s1": "running"}
    assert [r["seq"] for r in last_events(kept.log.read(), 2).collect()] == [3, 2]
    kept.save_diagnostics("s1", "report")
    assert kept.diagnostics("s1") == "report" and kept.diagnostics("s0") is None


def test_an_empty_log_has_no_events(store):
    assert EventLog(store).read().count() == 0


def test_micro_batches_hand_over_all_rows(spark, tmp_path):
    folder, seen = str(tmp_path / "in"), []
    spark.createDataFrame([(i,) for i in range(5)], "n int").write.parquet(folder)
    query = pipelines.micro_batches(pipelines.read_stream(spark, folder, "n int"), lambda rows, _: seen.extend(r["n"] for r in rows.collect()), str(tmp_path / "c"), delay_ms=50)
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == list(range(5))


def test_next_due(spark):
    rows = spark.createDataFrame([(0, True, False), (1, False, False), (2, False, True)], "i int, clean boolean, always boolean")
    due = rows.select(passes.next_due(F.lit(1000), F.lit(5), F.col("clean"), F.col("always"))).collect()
    assert [r[0] for r in due] == [301_000, None, 301_000]
