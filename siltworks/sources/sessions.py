"""Sessions, their diagnostics, and the event log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.operators import metrics
from siltworks.sources.store import Store

SHOWN = 50
EVENT = "seq BIGINT, session_id STRING, ts TIMESTAMP, event_type STRING, value DOUBLE, payload STRING"


class EventLog:
    """Events in a folder of Parquet files that is only ever appended to, by day."""

    def __init__(self, store: Store):
        self.spark, self.folder = store.spark, f"{store.root}/events"
        self._store = store

    def append(self, events: DataFrame) -> None:
        wanted = schema.struct(EVENT)
        rows = events.select(*[F.col(f.name).cast(f.dataType) for f in wanted]).withColumn("day", F.to_date("ts"))
        rows.write.mode("append").partitionBy("day").parquet(self.folder)

    def read(self) -> DataFrame:
        if not self._store._fs.exists(self._store._path(self.folder)):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(f"{EVENT}, day DATE").parquet(self.folder).drop("day")


def last_events(events: DataFrame, n: int = SHOWN, *, at: str = "ts", seq: str = "seq") -> DataFrame:
    """The last events, newest first: each task keeps n."""
    return events.orderBy(F.col(at).desc(), F.col(seq).desc()).limit(n)


class Sessions:
    """The current session and the history by id. Every write embeds the counters of the session's events, so that both agree with the log."""

    def __init__(self, store: Store):
        self.store, self.log = store, EventLog(store)

    def current(self) -> dict | None:
        """The current session, or None."""
        stored = self.store.get_state("current_session")
        return None if stored is None else json.loads(stored)

    def get(self, session_id: str) -> DataFrame:
        return self.store.get("sessions", session_id)

    def history(self) -> DataFrame:
        return self.store.read("sessions")

    def counters(self, session_id: str) -> str:
        """The counters of a session as JSON."""
        events = self.log.read().where(F.col("session_id") == session_id)
        counted = metrics.snapshot(events, by=["session_id"])
        row = counted.select(F.to_json(F.struct(*[c for c in counted.columns if c != "session_id"])).alias("metrics")).first()
        return row["metrics"] if row else "{}"

    def init(self, session_id: str, now: str) -> dict:
        """The stored session if there is one, else a new idle one."""
        return self.current() or self._write(session_id, "idle", now, now, 0)

    def start(self, session_id: str, now: str) -> dict:
        """A new running session becomes the current one; earlier ones stay in the history."""
        return self._write(session_id, "running", now, now, 0)

    def update(self, now: str, *, status: str | None = None, queue_depth: int | None = None) -> dict | None:
        """The current session with the given fields changed; without a session nothing happens."""
        was = self.current()
        if was is None:
            return None
        depth = was["queue_depth"] if queue_depth is None else queue_depth
        return self._write(was["id"], status or was["status"], was["started_at"], now, depth)

    def sync(self, queue_depth: int, now: str) -> dict | None:
        return self.update(now, queue_depth=queue_depth)

    def _write(self, session_id: str, status: str, started_at: str, now: str, queue_depth: int) -> dict:
        facts = (session_id, status, started_at, now, queue_depth, self.counters(session_id))
        self.store.start_session(self.store.spark.createDataFrame([facts], schema.SESSION))
        return self.current()

    def save_diagnostics(self, session_id: str, report: str) -> int:
        return self.store.save("diagnostics", self.store.spark.createDataFrame([(session_id, report)], schema.DIAGNOSTICS))

    def diagnostics(self, session_id: str) -> str | None:
        row = self.store.get("diagnostics", session_id).first()
        return row["report"] if row else None
