"""Schemas of the tables, and versions of the store."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import types as T

STATES = ("discovered", "extracted", "persisted", "hydrated", "enriched", "exported")
TASK_STATES = ("queued", "opening", "extracting", "completed", "failed")
BLOCKS = ("text", "heading", "quote", "code", "list_item", "transcript")
MEDIA_KINDS = ("image", "video", "audio", "document", "unknown")
FAILURES = ("navigation", "extraction", "normalization", "persistence", "unknown")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


SOURCE = "STRUCT<provider_name: STRING, external_id: STRING, original_uri: STRING, extracted_at: STRING, metadata: STRING>"
AUTHOR = "STRUCT<external_id: STRING, handle: STRING, display_name: STRING, avatar_uri: STRING, profile_uri: STRING>"
CONTENT = "ARRAY<STRUCT<type: STRING, value: STRING, metadata: STRING>>"
MEDIA = "ARRAY<STRUCT<id: STRING, type: STRING, source_uri: STRING, local_uri: STRING, mime_type: STRING, size_bytes: BIGINT>>"
COMPLETENESS = "STRUCT<thumbnail: BOOLEAN, metadata: BOOLEAN, media: BOOLEAN, ocr: BOOLEAN>"
CHILD = f"STRUCT<id: STRING, kind: STRING, state: STRING, source: {SOURCE}, author: {AUTHOR}, content: {CONTENT}, media: {MEDIA}, completeness: {COMPLETENESS}>"
#: children: null if there is no such field, empty if there are none. Metadata bags are JSON texts.
RESOURCE = f"id STRING, kind STRING, state STRING, source {SOURCE}, author {AUTHOR}, content {CONTENT}, media {MEDIA}, children ARRAY<{CHILD}>, completeness {COMPLETENESS}"
MEDIA_METADATA = "id STRING, type STRING, mime_type STRING, size_bytes BIGINT, hash STRING, storage_path STRING, state STRING, created_at STRING, last_access STRING, source STRING"
PARSED_POST = "provider_name STRING, source_uri STRING, external_id STRING, author_handle STRING, author_display_name STRING, text_content STRING, media_uris ARRAY<STRING>, slide_uris ARRAY<STRING>, video_uri STRING, published_at STRING, layout STRING"
TASK = "id STRING, target_uri STRING, state STRING, priority INT, attempts INT, max_attempts INT, next_retry_at BIGINT, last_error STRING, seq BIGINT"
MANIFEST = "target STRING, last_exported_at STRING, last_request_id STRING, resources_exported_total BIGINT, export_count BIGINT, created_at STRING, updated_at STRING"
CONTROL_STATE = "key STRING, value STRING"
SESSION = "id STRING, status STRING, started_at STRING, updated_at STRING, queue_depth BIGINT, metrics STRING"
DIAGNOSTICS = "session_id STRING, report STRING"

TABLES = {
    "resources": RESOURCE,
    "media_metadata": MEDIA_METADATA,
    "tasks": TASK,
    "sessions": SESSION,
    "diagnostics": DIAGNOSTICS,
    "control_state": CONTROL_STATE,
    "export_manifest": MANIFEST,
}
#: The key column of each table.
KEYS = {"resources": "id", "media_metadata": "id", "tasks": "target_uri", "sessions": "id", "diagnostics": "session_id", "control_state": "key", "export_manifest": "target"}


class Step(NamedTuple):
    """What a version changed: per table, columns as SQL over the columns of the version before (null: dropped)."""

    says: str
    columns: dict[str, dict[str, str | None]] = {}


#: Steps by version. Versions are only ever appended.
MIGRATIONS = {1: Step("tables"), 2: Step("state as a partition of resources")}
SCHEMA_VERSION = max(MIGRATIONS)
#: The version of snapshots whose names do not say it.
UNNAMED_VERSION = 2
