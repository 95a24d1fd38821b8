"""The task queue as a table: choice of the next task, transitions, retries, recovery and depth. Times are epoch milliseconds and are given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.operators.ranges import scan

MAX_ATTEMPTS = 3
BASE_DELAY_MS = 1000


def new_tasks(uris: DataFrame, *, priority: int = 0, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Queued tasks from target_uri, seq."""
    return uris.select(F.col("target_uri").alias("id"), "target_uri", F.lit("queued").alias("state"), F.lit(priority).alias("priority"), F.lit(0).alias("attempts"), F.lit(max_attempts).alias("max_attempts"), F.lit(None).cast("long").alias("next_retry_at"), F.lit(None).cast("string").alias("last_error"), F.col("seq").cast("long"))


def is_ready(now: int | Column) -> Column:
    due = F.coalesce("next_retry_at", F.lit(0))
    return (F.col("state") == "queued") & ((due == 0) | (due <= (now if isinstance(now, Column) else F.lit(now))))


def next_task(tasks: DataFrame, now: int) -> DataFrame:
    """The ready task of highest priority, the earliest of equal ones; no row if none is ready."""
    return tasks.where(is_ready(now)).orderBy(F.desc("priority"), "seq").limit(1)


def backoff(attempts: Column, base: int = BASE_DELAY_MS) -> Column:
    """base * 2 ** (attempts - 1)."""
    return (F.lit(base) * F.pow(F.lit(2), attempts - 1)).cast("long")


def apply(tasks: DataFrame, events: DataFrame, *, base: int = BASE_DELAY_MS) -> DataFrame:
    """Tasks after one event each (target_uri, event, at, error): opening, extracting, completed, failed or failed_permanently."""
    rows = tasks.join(events.select("target_uri", "event", "at", "error"), "target_uri", "left")
    tries = F.col("attempts") + 1
    failed, final = F.col("event") == "failed", F.col("event") == "failed_permanently"
    again = failed & (tries < F.col("max_attempts"))
    changes = {
        "state": F.when(F.col("event").isin("opening", "extracting", "completed"), F.col("event")).when(again, "queued").when(failed | final, "failed").otherwise(F.col("state")),
        "next_retry_at": F.when(again, F.col("at") + backoff(tries, base)).when(failed | final, None).otherwise(F.col("next_retry_at")),
        "last_error": F.when(failed | final, F.col("error")).otherwise(F.col("last_error")),
        "attempts": F.when(failed, tries).when(final, F.col("max_attempts")).otherwise(F.col("attempts")),
    }
    return rows.withColumns(changes).select(*tasks.columns)


def restore(tasks: DataFrame) -> DataFrame:
    """Tasks that were under way are queued again; the rest stays, so doing it twice changes nothing."""
    return tasks.withColumn("state", F.when(F.col("state").isin("opening", "extracting"), "queued").otherwise(F.col("state")))


def depth(tasks: DataFrame) -> DataFrame:
    """queue_depth, drained."""
    active = F.col("state").isin("queued", "opening", "extracting")
    return tasks.agg(F.count_if(F.col("state") == "queued").alias("queue_depth"), (~F.coalesce(F.bool_or(active), F.lit(False))).alias("drained"))


def retry_schedule(failures: DataFrame, *, task: str, at: str, tie: str, base: int = BASE_DELAY_MS, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Failures of each task in order of time with their attempt number, delay and the time (ms) of the retry; null once attempts are used up.

    Only attempts up to max_attempts matter, so each task keeps that many rows.
    """
    order = Window.partitionBy(task).orderBy(at, tie)
    rows = failures.withColumn("attempt", F.row_number().over(order)).where(F.col("attempt") <= max_attempts)
    delay = F.when(F.col("attempt") < max_attempts, backoff(F.col("attempt"), base))
    return rows.withColumn("delay_ms", delay).withColumn("next_retry_at", F.unix_millis(F.col(at).cast("timestamp")) + F.col("delay_ms"))


def is_permanent(stage: Column, message: Column) -> Column:
    """Failures that a retry cannot mend."""
    return ((stage == "navigation") & message.rlike("(?i)not found")) | ((stage == "extraction") & message.rlike("(?i)no article element"))


def failure_category(stage: Column) -> Column:
    return F.when(stage.isin("navigation", "extraction", "normalization"), stage).otherwise("unknown")


def empty_streaks(scrolls: DataFrame, *, session: str, order: list[str], found: Column) -> DataFrame:
    """Each scroll with the number of scrolls without new work in a row up to it; one session of most scrolls is spread over ranges.

    The scrolls without new work up to a scroll, less as many as there were at the last scroll with new work: the greatest such number so far, as it never falls.
    """
    rows = scan(scrolls, order, by=[session], sums={"_empty": (~found).cast("long")})
    rows = scan(rows.withColumn("_found", found), order, by=[session], maxima={"_reset": F.when(F.col("_found"), F.col("_empty"))})
    return rows.withColumn("empty_scrolls", F.col("_empty") - F.coalesce("_reset", F.lit(0))).drop("_empty", "_reset", "_found")


def is_idle(streaks: DataFrame, *, session: str, limit: int = 3) -> DataFrame:
    """Per session, whether it ever had that many empty scrolls in a row."""
    return streaks.groupBy(session).agg((F.max("empty_scrolls") >= limit).alias("finished"))
