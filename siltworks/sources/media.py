"""Media: bytes with metadata, statistics, integrity and cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.functions import text as tx


def read_blobs(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of the files below a folder."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(folder)


def read_sidecars(texts: DataFrame, column: str = "value") -> DataFrame:
    """Metadata from JSON texts: those that can be read and whose media are complete."""
    parsed = texts.select(F.from_json(column, schema.MEDIA_METADATA, {"mode": "PERMISSIVE"}).alias("m"))
    return parsed.where("m.id IS NOT NULL AND m.state = 'complete'").select("m.*")


def put(new: DataFrame, existing: DataFrame, now: str) -> DataFrame:
    """Metadata rows of new media (id, type, mime_type, content, source): digest, size and path; created_at stays on overwriting."""
    old = existing.select(F.col("id"), F.col("created_at").alias("old_created_at"))
    rows = new.join(old, "id", "left")
    kind = F.coalesce("type", F.lit("unknown"))
    return rows.select(
        "id",
        kind.alias("type"),
        "mime_type",
        F.length("content").cast("long").alias("size_bytes"),
        F.sha2("content", 256).alias("hash"),
        tx.blob_path(F.col("id"), kind).alias("storage_path"),
        F.lit("complete").alias("state"),
        F.coalesce("old_created_at", F.lit(now)).alias("created_at"),
        F.lit(now).alias("last_access"),
        "source",
    )


def completed(metadata: DataFrame) -> DataFrame:
    return metadata.where(F.col("state") == "complete")


def with_last_access(metadata: DataFrame, accesses: DataFrame) -> DataFrame:
    """Metadata with last_access taken from a log of accesses (id, at) where that is later."""
    seen = accesses.groupBy("id").agg(F.max("at").alias("at"))
    return metadata.join(seen, "id", "left").withColumn("last_access", F.greatest("last_access", "at")).drop("at").select(*metadata.columns)


def verify(metadata: DataFrame, blobs: DataFrame) -> DataFrame:
    """id, ok: whether bytes of the stated size and digest are at the stated path. blobs: path, content."""
    found = metadata.join(blobs.select(F.col("path").alias("storage_path"), "content"), "storage_path", "left")
    ok = F.coalesce((F.length("content") == F.col("size_bytes")) & (F.sha2("content", 256) == F.col("hash")), F.lit(False))
    return found.select("id", ok.alias("ok"))


def statistics(metadata: DataFrame, kind: str | Column = "type", size: str | Column = "size_bytes") -> DataFrame:
    """Count and bytes by kind, and of all kinds together in the row with a null kind; aggregated once."""
    rows = metadata.select((F.col(kind) if isinstance(kind, str) else kind).alias("kind"), (F.col(size) if isinstance(size, str) else size).alias("size"))
    return rows.rollup("kind").agg(F.count("*").alias("media_count"), F.sum("size").alias("total_bytes"), F.grouping("kind").alias("is_total"))


def orphan_metadata(metadata: DataFrame, blobs: DataFrame) -> DataFrame:
    """Metadata whose bytes are gone."""
    return metadata.join(blobs.select(F.col("path").alias("storage_path")), "storage_path", "left_anti")


def orphan_blobs(blobs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Blobs that no complete metadata names; metadata files and unfinished ones are no such blobs."""
    stored = blobs.where(~F.col("path").startswith("media/meta/") & ~F.col("path").startswith("media/tmp/"))
    return stored.join(completed(metadata).select(F.col("storage_path").alias("path")), "path", "left_anti")


def unfinished(blobs: DataFrame) -> DataFrame:
    return blobs.where(F.col("path").startswith("media/tmp/"))


def cleanup_report(metadata: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row: how many of each a cleanup removes."""
    found = orphan_metadata(metadata, blobs).select(F.lit("metadata").alias("what"))
    found = found.unionByName(orphan_blobs(blobs, metadata).select(F.lit("blob").alias("what"))).unionByName(unfinished(blobs).select(F.lit("tmp").alias("what")))
    return found.agg(*[F.count_if(F.col("what") == what).alias(name) for what, name in (("metadata", "orphan_metadata_removed"), ("blob", "orphan_blobs_removed"), ("tmp", "tmp_removed"))])
