"""Session metrics, failures and reports, computed from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions.text import js_round
from siltworks.operators.ranges import scan
from siltworks.session import shuffle_width

#: Counter: the event type that it counts.
COUNTERS = {
    "discovered": "discovered",
    "queued": "queued",
    "duplicates": "duplicate",
    "navigations": "navigated",
    "extracted": "extracted",
    "normalized": "normalized",
    "persisted": "persisted",
    "skipped": "skipped",
    "retries": "retried",
    "navigation_failures": "navigation_failed",
    "extraction_failures": "extraction_failed",
    "normalization_failures": "normalization_failed",
}
#: Total: event type whose value it sums.
TIMES = {"navigation": "navigated", "extraction": "extracted", "persistence": "persisted"}


def average(total: Column, count: Column) -> Column:
    """To one decimal, half up; 0 if there is nothing to average."""
    return F.when(count > 0, js_round(total.cast("double") / count, 1)).otherwise(0.0)


def snapshot(events: DataFrame, *, by: list[str], kind: str = "event_type", value: str = "value", at: str = "ts", counters: dict[str, str] | None = None, times: dict[str, str] | None = None, depth: str | None = None) -> DataFrame:
    """Counters, summed and average times, greatest queue depth and duration (ms) per group, in one aggregate."""
    is_ = lambda e: F.col(kind) == e
    columns = [F.count_if(is_(e)).alias(n) for n, e in (counters if counters is not None else COUNTERS).items()]
    for name, e in (times if times is not None else TIMES).items():
        total = F.coalesce(F.sum(F.when(is_(e), F.col(value))), F.lit(0))
        columns += [total.alias(f"{name}_ms_total"), average(total, F.count_if(is_(e))).alias(f"{name}_ms_average")]
    if depth is not None:
        columns.append(F.max(depth).alias("peak_queue_depth"))
    span = F.unix_millis(F.max(F.col(at).cast("timestamp"))) - F.unix_millis(F.min(F.col(at).cast("timestamp")))
    return events.groupBy(*by).agg(*columns, span.alias("duration_ms"))


def peak_depth(changes: DataFrame, *, by: list[str], order: list[str], delta: str = "delta") -> DataFrame:
    """Greatest running sum of queue changes per group; one group of most rows is spread over ranges of its order."""
    return scan(changes, order, by=by, sums={"_depth": F.col(delta)}).groupBy(*by).agg(F.max("_depth").alias("peak_queue_depth"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    """One row: a map from each value to its count."""
    return df.groupBy(column).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias("histogram"))


def state_counts(resources: DataFrame, column: str = "state") -> DataFrame:
    """Count per state, and in all in the row with a null state."""
    return resources.rollup(column).agg(F.count("*").alias("n"), F.grouping(column).alias("is_total"))


SNAPSHOT_CHARS = 2000
#: Failure records that a task gathers, about; with whole snapshots they take some 100 MB.
GATHERED = 50_000


def failures(events: DataFrame, *, by: list[str], order: list[str]) -> DataFrame:
    """Failure records per group in order: category, root_cause, dom_snapshot (cut), and optional fields where given."""
    given = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    record = F.struct(F.col("category"), F.col("root_cause"), F.substring("dom_snapshot", 1, SNAPSHOT_CHARS).alias("dom_snapshot"), given("resource_uri"), given("strategy"))
    # The number of tasks follows that of records, so what a task gathers and sorts does not grow with the input.
    parts = max(shuffle_width(events.sparkSession), -(-events.count() // GATHERED))
    cut = events.select(*by, F.struct(*order, record.alias("_record")).alias("_one")).repartition(parts, *by)
    packed = cut.groupBy(*by).agg(F.array_sort(F.collect_list("_one")).alias("_all"))
    return packed.select(*by, F.transform("_all", lambda x: x["_record"]).alias("failures"))


def session_report(metrics: DataFrame, failed: DataFrame, strategies: DataFrame, *, session: str = "session_id") -> DataFrame:
    """One row per session: metrics, failures and how often each strategy was used (strategies: session, strategy)."""
    used = strategies.groupBy(session, "strategy").agg(F.count("*").alias("n")).groupBy(session).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("strategy", "n")))).alias("strategy_usage"))
    packed = metrics.select(session, F.struct(*[c for c in metrics.columns if c != session]).alias("metrics"))
    return packed.join(failed, session, "left").join(used, session, "left")


def smoke_verdict(metrics: DataFrame, *, by: list[str] = []) -> DataFrame:  # noqa: B006 never changed
    """Whether anything was discovered, extracted and persisted, in all or beside the columns of by."""
    names = ("discovered", "extracted", "persisted")
    return metrics.select(*by, *[(F.col(n) > 0).alias(f"any_{n}") for n in names]).withColumn("passed", F.expr(" AND ".join(f"any_{n}" for n in names)))
