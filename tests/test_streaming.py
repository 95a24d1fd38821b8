import time

import pytest

from siltworks.sources.store import Store
from siltworks.streaming import pipelines

EVENT = "target_uri STRING, event STRING, at BIGINT, seq BIGINT"


def write(spark, folder, rows, ddl=EVENT):
    spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(folder)


def test_first_of_each_fingerprint(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [("a", 1), ("b", 2)], "fingerprint STRING, n INT")
    write(spark, folder, [("a", 3), ("c", 4)], "fingerprint STRING, n INT")
    stream = pipelines.read_stream(spark, folder, "fingerprint STRING, n INT", files_per_batch=1)
    got = pipelines.run_available(pipelines.distinct_discoveries(stream), "t_first")
    assert sorted(r["fingerprint"] for r in got.collect()) == ["a", "b", "c"]


def test_task_machine_over_batches_and_restart(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [("u", "enqueue", 0, 0), ("u", "opening", 1, 1), ("u", "failed", 1000, 2)])
    run = lambda: {r["target_uri"]: (r["state"], r["attempts"], r["next_retry_at"]) for r in pipelines.run_available(pipelines.task_machine(pipelines.read_stream(spark, folder, EVENT), timers=False), "t_tasks", mode="update", checkpoint=None).collect()}
    assert run() == {"u": ("queued", 1, 2000)}
    write(spark, folder, [("u", "failed", 5000, 3), ("u", "enqueue", 5001, 4), ("w", "completed", 0, 5)])
    assert run() == {"u": ("queued", 2, 7000)}


@pytest.mark.parametrize(
    ("events", "state"),
    [
        (["enqueue", "opening", "extracting", "completed", "enqueue"], ("completed", 0, 0)),
        (["enqueue", "failed", "failed", "failed"], ("failed", 3, 0)),
        (["enqueue", "failed_permanently"], ("failed", 3, 0)),
        (["enqueue", "extracting"], ("queued", 0, 0)),
        (["opening"], None),
    ],
)
def test_steps(events, state):
    now = None
    for e in events:
        now = pipelines.step(now, e, 0)
    assert now == state


def test_counters(spark, tmp_path):
    folder = str(tmp_path / "in")
    write(spark, folder, [("s", "discovered"), ("s", "discovered"), ("s", "persisted")], "session_id STRING, event_type STRING")
    got = pipelines.run_available(pipelines.live_counters(pipelines.read_stream(spark, folder, "session_id STRING, event_type STRING"), "session_id"), "t_live", mode="complete").first()
    assert (got["discovered"], got["persisted"], got["skipped"]) == (2, 1, 0)


def test_idle_sessions(spark, tmp_path):
    folder, ddl = str(tmp_path / "in"), "session_id STRING, seq INT, found BOOLEAN"
    write(spark, folder, [("a", 0, False), ("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 0, False), ("b", 1, False), ("b", 2, False), ("b", 3, True)], ddl)
    got = pipelines.run_available(pipelines.idle_machine(pipelines.read_stream(spark, folder, ddl)), "t_idle", mode="update")
    assert {r["session_id"]: (r["empty_scrolls"], r["finished"]) for r in got.collect()} == {"a": (1, False), "b": (0, True)}


def collecting(stream, rows, checkpoint, until, seconds=90):
    """Runs a stream until the rows that it has put out are enough."""
    query = pipelines.micro_batches(stream, lambda batch, _: rows.extend(map(tuple, batch.collect())), checkpoint, delay_ms=100, mode="update")
    end = time.time() + seconds
    try:
        while not until(rows) and time.time() < end and query.isActive:
            time.sleep(0.1)
        assert until(rows), (rows, query.exception())
    finally:
        query.stop()


def test_retry_timers_fire_after_a_restart(spark, tmp_path):
    folder, checkpoint, rows = str(tmp_path / "in"), str(tmp_path / "checkpoint"), []
    at = int(time.time() * 1000)
    write(spark, folder, [("u", "enqueue", at, 0), ("u", "failed", at, 1), ("w", "enqueue", at, 0), ("w", "failed", at, 1), ("w", "completed", at, 2)])
    machine = lambda: pipelines.task_machine(pipelines.read_stream(spark, folder, EVENT), base=15_000)
    collecting(machine(), rows, checkpoint, lambda x: len(x) == 2)
    assert sorted(rows) == [("u", "queued", 1, at + 15_000, "event"), ("w", "completed", 1, at + 15_000, "event")]
    collecting(machine(), rows, checkpoint, lambda x: len(x) > 2)
    assert rows[2:] == [("u", "queued", 1, at + 15_000, "retry_due")] and int(time.time() * 1000) >= at + 15_000


def test_sessions_end_by_silence(spark, tmp_path):
    folder, rows, ddl = str(tmp_path / "in"), [], "session_id STRING, found BOOLEAN"
    write(spark, folder, [("a", True), ("a", None), ("b", False)], ddl)
    machine = pipelines.silence_machine(pipelines.read_stream(spark, folder, ddl), tick=200, settle=400)
    collecting(machine, rows, str(tmp_path / "checkpoint"), lambda x: sum(r[1] == "finished" for r in x) == 2)
    for session in "ab":
        said = [r[1:] for r in rows if r[0] == session]
        assert [x[:2] for x in said] == [("scroll", 1), ("scroll", 2), ("scroll", 3), ("finished", 3)]
        assert all(later[2] - sooner[2] >= 400 for sooner, later in zip(said, said[1:], strict=False))


def test_a_batch_enters_the_store_once(spark, tmp_path):
    folder, store, ddl = str(tmp_path / "in"), Store(spark, str(tmp_path / "store")), "target_uri STRING"
    counts = lambda: {r["target_uri"]: r["seen"] for r in store.read("counts").collect()}
    run = lambda checkpoint: pipelines.into_store(pipelines.queue_counts(pipelines.read_stream(spark, folder, ddl, files_per_batch=1)), store, "counts", "target_uri", "t_counts", str(tmp_path / checkpoint)).awaitTermination()
    write(spark, folder, [("a",), ("a",), ("b",)], ddl)
    run("c1")
    write(spark, folder, [("a",), ("c",)], ddl)
    run("c1")
    assert counts() == {"a": 3, "b": 1, "c": 1}
    before = store.latest_number()
    run("c2")  # batches 0 and 1 are handed over again
    assert counts() == {"a": 3, "b": 1, "c": 1} and store.latest_number() == before
    store.put_state("other", "1")
    write(spark, folder, [("b",)], ddl)
    run("c1")
    assert counts() == {"a": 3, "b": 2, "c": 1} and store.get_state("other") == "1"


def test_gathered_batches(spark, tmp_path):
    folder, store, ddl = str(tmp_path / "in"), Store(spark, str(tmp_path / "store")), "target_uri STRING"
    write(spark, folder, [("a",), ("b",)], ddl)
    query = pipelines.into_store(pipelines.queue_counts(pipelines.read_stream(spark, folder, ddl)), store, "counts", "target_uri", "t_gathered", str(tmp_path / "c"), delay_ms=150)
    try:
        query.processAllAvailable()
        write(spark, folder, [("b",)], ddl)
        query.processAllAvailable()
    finally:
        query.stop()
    assert {r["target_uri"]: r["duplicates"] for r in store.read("counts").collect()} == {"a": 0, "b": 1} and store.get_state("stream t_gathered") == "1"
