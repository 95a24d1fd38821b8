"""The unbounded side: discoveries with stateful de-duplication, the task machine with retry timers, and running counters."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siltworks import schema
from siltworks.operators.metrics import COUNTERS
from siltworks.operators.scheduler import BASE_DELAY_MS, MAX_ATTEMPTS
from siltworks.session import shared_folder
from siltworks.sources.store import Conflict, Store, upsert


def read_stream(spark: SparkSession, folder: str, ddl: str, *, files_per_batch: int | None = None, names: str = "*.parquet") -> DataFrame:
    """The Parquet files of a folder whose names match as an unbounded table."""
    reader = spark.readStream.schema(ddl).option("pathGlobFilter", names)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def distinct_discoveries(stream: DataFrame, *, key: str = "fingerprint", event_time: str | None = None, horizon: str | None = None) -> DataFrame:
    """The first row of each fingerprint. Without a horizon all fingerprints are remembered, as the semantics ask for; with event_time and
    horizon the state is bounded, and a repeat after the horizon passes again."""
    if event_time and horizon:
        return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark([key])
    return stream.dropDuplicates([key])


def queue_counts(stream: DataFrame, key: str = "target_uri") -> DataFrame:
    """Per address, how often it came; all but the first are duplicates."""
    return stream.groupBy(key).agg(F.count("*").alias("seen")).withColumn("duplicates", F.col("seen") - 1)


def live_counters(stream: DataFrame, by: str, kind: str = "event_type") -> DataFrame:
    """The session counters, updated as events come."""
    return stream.groupBy(by).agg(*[F.count_if(F.col(kind) == e).alias(n) for n, e in COUNTERS.items()])


TASK_OUT = "target_uri STRING, state STRING, attempts INT, next_retry_at BIGINT, cause STRING"
TASK_STATE = "state STRING, attempts INT, next_retry_at BIGINT"
#: Event: the states in which it is obeyed.
OBEYED = {"opening": ("queued",), "extracting": ("opening",), "completed": None, "failed": None, "failed_permanently": None}


def step(state: tuple | None, event: str, at: int, *, base: int = BASE_DELAY_MS, max_attempts: int = MAX_ATTEMPTS) -> tuple | None:
    """(state, attempts, next_retry_at) after an event; an address is tracked from its first 'enqueue' on."""
    if event == "enqueue":
        return state or ("queued", 0, 0)
    if state is None or event not in OBEYED or (OBEYED[event] is not None and state[0] not in OBEYED[event]):
        return state
    if event == "failed":
        tries = state[1] + 1
        return ("queued", tries, at + base * 2 ** (tries - 1)) if tries < max_attempts else ("failed", tries, 0)
    if event == "failed_permanently":
        return ("failed", max_attempts, 0)
    return (event, state[1], state[2])


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store; the setting counts for streams that are started afterwards. Its class has moved between versions of Spark."""
    moved = ROCKSDB.replace("state.", "operators.stateful.state.")
    for name in (ROCKSDB, moved):
        try:
            spark._jvm.java.lang.Class.forName(name, False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        except Exception:  # noqa: S112 not under this name
            continue
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", name)
        return


def with_heartbeat(stream: DataFrame) -> DataFrame:
    """stream with a source that brings no rows but new offsets every second, so that micro-batches run and timers fire while nothing comes, after a restart too."""
    beats = stream.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
    return stream.unionByName(beats.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]))


def _frame(rows: list[tuple], ddl: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ddl.split(", ")])


class TaskProcessor(StatefulProcessor):
    """The state of one address: a value, and a timer for when its retry is due. Of a micro-batch's events only (at, seq, event) are held, to be sorted."""

    def __init__(self, base: int, max_attempts: int, timers: bool):
        self.base, self.max_attempts, self.timers = base, max_attempts, timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("task", TASK_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = now = tuple(self.value.get()) if self.value.exists() else None
        events = sorted((int(at), int(seq), event) for frame in rows for at, seq, event in zip(frame["at"], frame["seq"], frame["event"], strict=True))
        for at, _, event in events:
            now = step(now, event, at, base=self.base, max_attempts=self.max_attempts)
        if now is None:
            return
        self.value.update(now)
        if self.timers and now != before:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            if now[0] == "queued" and now[2]:
                self.handle.registerTimer(max(now[2], timerValues.getCurrentProcessingTimeInMs() + 1))
        yield _frame([(key[0], *now, "event")], TASK_OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            yield _frame([(key[0], *self.value.get(), "retry_due")], TASK_OUT)

    def close(self) -> None:
        pass


def task_machine(stream: DataFrame, *, base: int = BASE_DELAY_MS, max_attempts: int = MAX_ATTEMPTS, timers: bool = True) -> DataFrame:
    """Tasks by address from events (target_uri, event, at, seq): a row per address and micro-batch, and one when a retry falls due. Timers live in the
    checkpoint, so they fire after a restart too."""
    keep_state_in_rocksdb(stream.sparkSession)
    events = stream.select("target_uri", "event", F.col("at").cast("long"), F.col("seq").cast("long"))
    keyed = (with_heartbeat(events) if timers else events).groupBy("target_uri")
    return keyed.transformWithStateInPandas(TaskProcessor(base, max_attempts, timers), TASK_OUT, "Update", "ProcessingTime" if timers else "None")


SILENCE_OUT = "session_id STRING, action STRING, empty_scrolls INT, at BIGINT"
#: Milliseconds between looks at a session, and for which discovery may report after a start or scroll; scrolls without new work that end a session.
TICK_MS, SETTLE_MS, MAX_EMPTY_SCROLLS = 800, 1500, 3


class SilenceProcessor(StatefulProcessor):
    """One session. New work starts the count of empty scrolls again; a timer looks at the session every tick: while discovery may still report it waits,
    after as many empty scrolls as may be it finishes the session, else it asks for a scroll, counts it and opens a new time for discovery."""

    def __init__(self, tick: int, settle: int, limit: int):
        self.tick, self.settle, self.limit = tick, settle, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("session", "empty_scrolls INT, opportunity BIGINT, finished BOOLEAN")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        known = self.value.exists()
        empty, opportunity, finished = self.value.get() if known else (0, now, False)
        found = any(frame["found"].any() for frame in rows)
        if not known:
            self.handle.registerTimer(now + self.tick)
        self.value.update((0 if found and not finished else empty, opportunity, finished))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        empty, opportunity, finished = self.value.get()
        action = None
        if not finished and now - opportunity >= self.settle:
            finished = empty >= self.limit
            action, empty, opportunity = ("finished", empty, opportunity) if finished else ("scroll", empty + 1, now)
        self.value.update((empty, opportunity, finished))
        if not finished:
            self.handle.registerTimer(now + self.tick)
        if action:
            yield _frame([(key[0], action, empty, now)], SILENCE_OUT)

    def close(self) -> None:
        pass


def silence_machine(stream: DataFrame, *, tick: int = TICK_MS, settle: int = SETTLE_MS, limit: int = MAX_EMPTY_SCROLLS) -> DataFrame:
    """What is to be done with sessions, from discoveries (session_id, found: whether there was new work): scrolls, and the end of a session, which comes by silence alone."""
    keep_state_in_rocksdb(stream.sparkSession)
    keyed = with_heartbeat(stream.select("session_id", F.coalesce("found", F.lit(False)).alias("found"))).groupBy("session_id")
    return keyed.transformWithStateInPandas(SilenceProcessor(tick, settle, limit), SILENCE_OUT, "Update", "ProcessingTime")


IDLE_OUT = "session_id STRING, empty_scrolls INT, finished BOOLEAN"


def idle_machine(stream: DataFrame, *, limit: int = 3) -> DataFrame:
    """Sessions with their scrolls without new work in a row, from scrolls (session_id, seq, found): new work starts the count again, and a session
    with `limit` of them is finished for good."""

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty, finished = state.get if state.exists else (0, False)
        for found in pd.concat(list(batches)).sort_values("seq")["found"]:
            empty = 0 if found else empty + 1
            finished = finished or empty >= limit
        state.update((empty, finished))
        yield pd.DataFrame({"session_id": [key[0]], "empty_scrolls": [empty], "finished": [finished]})

    keyed = stream.select("session_id", "seq", "found").groupBy("session_id")
    return keyed.applyInPandasWithState(advance, IDLE_OUT, "empty_scrolls INT, finished BOOLEAN", "update", GroupStateTimeout.NoTimeout)


def micro_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, delay_ms: int = 150, mode: str = "append") -> StreamingQuery:
    """Starts a stream that gathers for a fixed delay and then hands over what has come as one batch; handle must take a batch again after a
    crash."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=f"{delay_ms} milliseconds")
    return writer.foreachBatch(handle).start()


def into_store(df: DataFrame, store: Store, table: str, key: str, name: str, checkpoint: str, *, delay_ms: int | None = None, tries: int = 9) -> StreamingQuery:
    """Starts a stream whose rows, the newest of each key, are kept in a table of the store; with delay_ms it gathers for that long before each
    batch, without it ends when it has read what is there.

    A batch's rows and its number are one commit, so a batch that is handed over again after a crash changes nothing. `name` stands for the
    checkpoint: a stream with a checkpoint of its own needs a name of its own. Rows of one batch have distinct keys (those of an aggregation have). A commit
    rewrites the table, so this is for results with a row per session or address, not for events.
    """
    mark = f"stream {name}"

    def add(batch: DataFrame, number: int) -> None:
        for _ in range(tries):
            base = store.latest_number()
            control = store.read("control_state", base)
            done = control.where(F.col("key") == mark).first()
            if done is not None and int(done["value"]) >= number:
                batch.write.format("noop").mode("overwrite").save()  # the stream's own state has to come to this batch all the same
                return
            old = store.read(table, base) if store.version(table) else batch.limit(0)
            noted = batch.sparkSession.createDataFrame([(mark, str(number))], schema.CONTROL_STATE)
            try:
                store.commit_all({table: upsert(old, batch, key), "control_state": upsert(control, noted, "key")}, base=base)
            except Conflict:
                continue
            return
        raise Conflict(table)

    def keep(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # it is read twice
        try:
            add(batch, number)
        finally:
            batch.unpersist()

    if delay_ms is not None:
        return micro_batches(df, keep, checkpoint, delay_ms=delay_ms, mode="update")
    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(keep).start()


def run_available(df: DataFrame, name: str, *, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives what it put out, read from Parquet in the shared folder, where each micro-batch has a folder
    of its own that a repeated batch overwrites; in mode complete only the last batch counts."""
    spark = df.sparkSession
    out = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    last = [-1]

    def keep(batch: DataFrame, number: int) -> None:
        last[0] = max(last[0], number)
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    writer = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{out}/checkpoint")
    writer.foreachBatch(keep).start().awaitTermination()
    if last[0] < 0:
        return spark.createDataFrame([], df.schema)
    rows = f"{out}/rows/batch={last[0]}" if mode == "complete" else f"{out}/rows"
    return spark.read.schema(df.schema).parquet(rows).select(*df.columns)
