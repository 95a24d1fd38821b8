"""Least-recently-used retention under a byte cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.operators.ranges import running_before

ELIGIBLE = ("enriched", "exported")


def owners(resource_media: DataFrame) -> DataFrame:
    """media_id, owner: the resource that counts as a medium's owner among eligible ones (resource_id, state, media_id): the last, enriched ones
    before exported ones, then by id."""
    rows = resource_media.where(F.col("state").isin(*ELIGIBLE))
    return rows.groupBy("media_id").agg(F.max_by("resource_id", F.struct(F.col("state") == "exported", "resource_id")).alias("owner"))


def decide(media: DataFrame, resource_media: DataFrame, pinned: DataFrame, *, retain_video: bool = False) -> DataFrame:
    """media (media_id, size_bytes, last_access, type) with a decision; the rules are tried in this order."""
    rows = media.join(owners(resource_media), "media_id", "left")
    rows = rows.join(pinned.select(F.col("resource_id").alias("owner"), F.lit(True).alias("is_pinned")).distinct(), "owner", "left")
    video = F.lit(retain_video) & F.coalesce(F.col("type") == "video", F.lit(False))
    decision = F.when(video, "retained_video").when(F.col("owner").isNull(), "not_enriched").when(F.col("is_pinned"), "pinned").otherwise("evictable")
    return rows.withColumn("decision", decision).drop("is_pinned")


def _freed_before(rows: DataFrame, buckets: int | None) -> DataFrame:
    """Evictable bytes before each row in the order of last access and id; a last access that is no time comes first."""
    at = F.unix_millis(F.try_to_timestamp("last_access"))
    size = F.when(F.col("decision") == "evictable", F.col("size_bytes")).otherwise(0)
    return running_before(rows.withColumn("_at", at), ["_at", "last_access", "media_id"], size, "freed_before", parts=buckets).drop("_at")


def plan(media: DataFrame, resource_media: DataFrame, pinned: DataFrame, *, policy: str = "cache", max_bytes: int | None = None, retain_video: bool = False, failed: DataFrame | None = None, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Decisions with inspected and evicted flags, and the one-row report.

    failed (media_id): deletions known to fail; they free nothing and are not counted. buckets: ranges of time and id into which rows are
    dealt, by default as many as there are shuffle partitions.
    """
    rows = decide(media, resource_media, pinned, retain_video=retain_video)
    total = media.agg(F.coalesce(F.sum("size_bytes"), F.lit(0))).first()[0]
    over = 0 if policy == "keep" or max_bytes is None else max(0, total - max_bytes)
    if failed is not None:
        rows = rows.join(failed.select("media_id", F.lit(True).alias("_failed")).distinct(), "media_id", "left")
        rows = rows.withColumn("_size", F.col("size_bytes")).withColumn("size_bytes", F.when(F.col("_failed"), 0).otherwise(F.col("size_bytes")))
    else:
        rows = rows.withColumn("_failed", F.lit(None).cast("boolean"))
    rows = _freed_before(rows, buckets)
    inspected = F.col("freed_before") < over
    rows = rows.withColumn("inspected", inspected).withColumn("evicted", inspected & (F.col("decision") == "evictable") & F.col("_failed").isNull())
    count = lambda d: F.count_if(F.col("inspected") & (F.col("decision") == d))
    freed = F.coalesce(F.sum(F.when(F.col("evicted"), F.col("size_bytes"))), F.lit(0))
    report = rows.agg(
        F.count_if("inspected").alias("media_inspected"),
        F.count_if("evicted").alias("media_evicted"),
        freed.alias("bytes_freed"),
        count("retained_video").alias("skipped_retained_video"),
        count("not_enriched").alias("skipped_not_enriched"),
        count("pinned").alias("skipped_pinned"),
        F.lit(total).cast("long").alias("bytes_before"),
        F.greatest(F.lit(0), F.lit(total) - freed).cast("long").alias("bytes_after"),
        F.lit(policy != "keep" and over == 0).alias("skipped_under_cap"),
    )
    return rows.drop("_failed", "_size"), report
