"""Export: resources above a watermark, projected, serialized and delivered as one file, a distributed folder or an archive."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.functions import text as tx
from siltworks.operators.enrich import media_links
from siltworks.plans import passes
from siltworks.plans.gateways import Gateway
from siltworks.plans.passes import Cancelled
from siltworks.session import release, shuffle_width
from siltworks.sources import archive
from siltworks.sources.store import Store

INCLUSIONS = ("none", "link-local", "embed-remote")
NDJSON = "export.ndjson"
#: Fixed value: how names of exported files begin.
ARTIFACT_PREFIX = "knowledge-export-"


def above_watermark(extracted_at: Column, watermark: str | None) -> Column:
    """Later than the watermark, as ISO texts; all rows without one. An equal time is not later."""
    return F.lit(True) if watermark is None else extracted_at > F.lit(watermark)


def present_media(resources: DataFrame, media: DataFrame, inclusion: str, include_children: bool = False) -> DataFrame:
    """Resources with the set of their media whose bytes are there. No join is planned when nothing is to be included. Ids of media are never broadcast:
    what a narrow column of a wide table holds is estimated far too small."""
    none = F.array().cast("array<string>")
    if inclusion not in INCLUSIONS:
        raise ValueError(inclusion)
    if inclusion == "none":
        return resources.withColumn("present", none)
    there = media_links(resources, include_children).join(media.select(F.col("id").alias("media_id")).hint("merge"), "media_id", "left_semi")
    found = there.groupBy(F.col("resource_id").alias("id")).agg(F.collect_set("media_id").alias("present"))
    return resources.join(found.hint("merge"), "id", "left").withColumn("present", F.coalesce("present", none))


def _json_object(fields: list[tuple[str, Column]]) -> Column:
    """A JSON object with its keys in this order; fields whose JSON is null are left out."""
    parts = [F.when(value.isNotNull(), F.concat(F.lit(f'"{name}":'), value)) for name, value in fields]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*parts)), ","), F.lit("}"))


def json_string(x: Column) -> Column:
    """A JSON string, or null."""
    wrapped = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substr(wrapped, F.lit(2), F.char_length(wrapped) - 2))


def _author_json(author: Column) -> Column:
    return F.when(author.isNotNull(), _json_object([("handle", json_string(author["handle"])), ("displayName", json_string(author["display_name"])), ("profileUri", json_string(author["profile_uri"]))]))


def _frontmatter(row: Column) -> list[tuple[str, Column, bool]]:
    """Key, value, whether the value is JSON already, in the order of the notes."""
    source = row["source"]
    return [
        ("sourceUrl", source["original_uri"], False),
        ("providerName", source["provider_name"], False),
        ("externalId", source["external_id"], False),
        ("extractedAt", source["extracted_at"], False),
        ("author", _author_json(row["author"]), True),
        ("sourceMetadata", source["metadata"], True),
    ]


def frontmatter_json(row: Column) -> Column:
    fields = []
    for name, value, is_json in _frontmatter(row):
        text = value if is_json else json_string(value)
        fields.append((name, F.coalesce(text, F.lit("null")) if name == "sourceUrl" else text))
    return _json_object(fields)


def local_path(media_id: Column, present: Column, inclusion: str) -> Column:
    return F.when(F.array_contains(present, media_id) & F.lit(inclusion != "none"), F.concat(F.lit("media/"), media_id))


def _item_json(row: Column, present: Column, inclusion: str, children: Column | None) -> Column:
    body = F.transform(row["content"], lambda b: _json_object([("type", json_string(b["type"])), ("value", json_string(b["value"])), ("metadata", b["metadata"])]))
    media = F.transform(row["media"], lambda m: _json_object([("mediaId", json_string(m["id"])), ("type", json_string(m["type"])), ("sourceUri", json_string(m["source_uri"])), ("localPath", json_string(local_path(m["id"], present, inclusion)))]))
    array = lambda x: F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))
    fields = [("resourceId", json_string(row["id"])), ("kind", json_string(row["kind"])), ("frontmatter", frontmatter_json(row)), ("body", array(body)), ("media", array(media))]
    if children is not None:
        fields.append(("children", F.when(children.isNotNull(), array(F.transform(children, lambda c: _item_json(c, present, inclusion, None))))))
    return _json_object(fields)


def json_lines(items: DataFrame, inclusion: str) -> DataFrame:
    """id, line: one JSON object per resource; keys of absent values are left out, but an absent source URL is null."""
    row = F.struct(*items.columns)
    packed = items.select("id", "present", row.alias("r"))
    return packed.select("id", _item_json(F.col("r"), F.col("present"), inclusion, F.col("r.children")).alias("line"))


def _yaml(row: Column) -> list[Column]:
    lines = []
    for name, value, is_json in _frontmatter(row):
        text = value if is_json else tx.yaml_string(value)
        keep = F.concat(F.lit(f"{name}: "), text)
        lines.append(keep if name not in ("author", "sourceMetadata") else F.when(value.isNotNull(), keep))
    return lines


def _note(head: list[Column], row: Column, media: Column, tail: Column | None = None) -> Column:
    front = F.array_join(F.array_compact(F.array(F.lit("---"), *head, F.lit("---"))), "\n")
    body = F.when(F.size(row["content"]) > 0, F.array_join(F.transform(row["content"], lambda b: tx.render_block(b["type"], b["value"])), "\n\n", ""))
    shown = F.when(F.size(media) > 0, F.array_join(media, "\n\n"))
    parts = [front, body, shown, *([tail] if tail is not None else [])]
    return F.concat(F.array_join(F.array_compact(F.array(*parts)), "\n\n"), F.lit("\n"))


def markdown_note(row: Column, present: Column, inclusion: str) -> Column:
    media = F.transform(row["media"], lambda m: F.concat(F.lit("!["), m["type"], F.lit("]("), F.coalesce(local_path(m["id"], present, inclusion), m["source_uri"]), F.lit(")")))
    return _note(_yaml(row), row, media)


def vault_note(row: Column, present: Column, inclusion: str, children: Column | None) -> Column:
    provider = row["source"]["provider_name"]
    tags = F.concat(F.lit("tags: ["), row["kind"], F.when(provider != row["kind"], F.concat(F.lit(", "), provider)).otherwise(""), F.lit("]"))
    media = F.transform(
        row["media"],
        lambda m: F.when(local_path(m["id"], present, inclusion).isNotNull(), F.concat(F.lit("![["), tx.attachment_path(m["id"]), F.lit("]]"))).otherwise(F.concat(F.lit("!["), m["type"], F.lit("]("), m["source_uri"], F.lit(")"))),
    )
    tail = None
    if children is not None:
        links = F.transform(children, lambda c: F.concat(F.lit("- [["), c["kind"], F.lit("/"), tx.sanitize_path(c["id"]), F.lit("]]")))
        tail = F.when(F.size(children) > 0, F.concat(F.lit("## Children\n\n"), F.array_join(links, "\n")))
    return _note([tags, F.concat(F.lit("kind: "), row["kind"]), *_yaml(row)], row, media, tail)


PART = "struct<path:string,kind:string,text:string,media_id:string>"


def _parts(items: DataFrame, inclusion: str, note, note_path, media_path) -> DataFrame:
    """One row per part: a note, its media that are there, then the same for each child."""

    def one(row: Column, children: Column | None) -> Column:
        nothing = F.lit(None).cast("string")
        own = F.array(F.struct(note_path(row).alias("path"), F.lit("text").alias("kind"), note(row, children).alias("text"), nothing.alias("media_id")))
        there = F.filter(row["media"], lambda m: local_path(m["id"], F.col("present"), inclusion).isNotNull())
        blobs = F.transform(there, lambda m: F.struct(media_path(m["id"]).alias("path"), F.lit("binary").alias("kind"), nothing.alias("text"), m["id"].alias("media_id")))
        return F.concat(own, blobs)

    packed = items.select("id", "present", F.struct(*items.columns).alias("r"))
    children = F.flatten(F.coalesce(F.transform("r.children", lambda c: one(c, None)), F.array().cast(f"array<array<{PART}>>")))
    return packed.select("id", F.posexplode(F.concat(one(F.col("r"), F.col("r.children")), children)).alias("pos", "part")).select("id", "pos", "part.*")


def markdown_parts(items: DataFrame, inclusion: str) -> DataFrame:
    return _parts(items, inclusion, lambda r, _: markdown_note(r, F.col("present"), inclusion), lambda r: F.concat(r["id"], F.lit(".md")), lambda m: F.concat(F.lit("media/"), m))


def vault_parts(items: DataFrame, inclusion: str) -> DataFrame:
    return _parts(items, inclusion, lambda r, kids: vault_note(r, F.col("present"), inclusion, kids), lambda r: tx.note_path(r["kind"], r["id"]), tx.attachment_path)


def json_parts(items: DataFrame, inclusion: str) -> DataFrame:
    lines = json_lines(items, inclusion)
    return lines.select("id", F.lit(0).alias("pos"), F.lit(NDJSON).alias("path"), F.lit("text").alias("kind"), F.concat("line", F.lit("\n")).alias("text"), F.lit(None).cast("string").alias("media_id"))


#: Target: its serializer. More can be added.
SERIALIZERS = {"json": json_parts, "markdown": markdown_parts, "obsidian": vault_parts}


def bundle(parts: DataFrame) -> DataFrame:
    """Texts of a path appended in stream order: path, text, size_bytes."""
    texts = parts.where("kind = 'text'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("id", "pos", "text"))).alias("x"))
    return texts.select("path", F.array_join(F.transform("x", lambda p: p["text"]), "").alias("text")).withColumn("size_bytes", F.octet_length("text").cast("long"))


def entries(parts: DataFrame, blobs: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """path, content of an archive: texts, and media whose bytes are there; of entries of one path the first counts.

    direct (media_id, content) are bytes fetched for this archive; they come before those in blobs."""
    texts = bundle(parts).select("path", F.encode("text", "UTF-8").alias("content"))
    media = parts.where("kind = 'binary'").groupBy("path").agg(F.min_by("media_id", F.struct("id", "pos")).alias("media_id"))
    media = media.join(blobs.select("media_id", "content").hint("merge"), "media_id", "left")
    if direct is not None:
        media = media.join(direct.select("media_id", F.col("content").alias("_direct")).hint("merge"), "media_id", "left").withColumn("content", F.coalesce("_direct", "content"))
    return texts.unionByName(media.where(F.col("content").isNotNull()).select("path", "content"))


def write_ndjson(lines: DataFrame, folder: str) -> None:
    """A folder of part files, written in parallel."""
    lines.select("line").write.mode("errorifexists").text(folder)


def write_single_ndjson(lines: DataFrame, path: str) -> int:
    """One file in order of id, written in parts by tasks; gives its size."""
    return archive.write_file(lines.select("id", F.encode(F.concat("line", F.lit("\n")), "UTF-8").alias("content")), path, order="id").size


def write_zip(entry_rows: DataFrame, path: str) -> int:
    """An archive of stored entries in order of path, all dated 1980-01-01, written in parts by tasks; gives its number of entries."""
    return archive.write_archive(entry_rows, path).entries


def write_texts(parts: DataFrame, path: str) -> int:
    """An archive of the texts of parts; the texts of a path are appended in stream order without being gathered in a row."""
    rows = parts.where("kind = 'text'").select("path", "id", "pos", F.encode("text", "UTF-8").alias("content"))
    return archive.write_archive(rows, path, order=("id", "pos")).entries


def zip_bytes(files: dict[str, bytes]) -> bytes:
    """A small archive in memory, in the same form."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED) as packed:
        for name in sorted(files):
            packed.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), files[name])
    return buffer.getvalue()


def crc32(data: bytes) -> int:
    return zlib.crc32(data)


def data_url(content: Column, mime_type: Column) -> Column:
    """One line; Spark's own encoding is broken into lines."""
    return F.concat(F.lit("data:"), mime_type, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


@dataclass
class Result:
    exported: int
    skipped: int
    media_included: int
    media_missing: int
    size_bytes: int
    delivered: bool


class OneFile:
    """The gateway of one file of lines, or one archive, written in parts by tasks and joined."""

    #: Endings of the names of lines and of archives.
    ENDINGS = ("ndjson", "zip")

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def lines(self, rows: DataFrame, path: str) -> int:
        return write_single_ndjson(rows, path)

    def archive(self, entry_rows: DataFrame, path: str) -> int:
        return archive.write_archive(entry_rows, path).size

    def discard(self, path: str) -> None:
        archive.remove(self.spark, f"{path}.partial")


class Coordinator:
    """Export runs over a store: at most one at a time, the manifest moves only after delivery.

    A run is a pass over pages of resources (passes.run_pass). Its items, with their media that are there, are first staged in order of id, once
    for all pages, so a page reads its own rows only. The parts of each page are staged, too, and the artifact is put together from them at the end, so a
    run that was interrupted goes on with the page it was at.
    """

    def __init__(self, store: Store, gateway: Gateway | None = None):
        self.store, self.running = store, False
        self.gateway = OneFile(store.spark) if gateway is None else gateway

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    def manifest(self, target: str):
        return self.store.get("export_manifest", target).first()

    def cancel(self, request_id: str) -> None:
        """Stops a run between its jobs and in them: nothing is delivered and its progress is cleared."""
        self.store.put_state(f"export_cancelled:{request_id}", "1")
        self.spark.sparkContext.cancelJobGroup(request_id)

    def _cancelled(self, request_id: str) -> bool:
        return self.store.get_state(f"export_cancelled:{request_id}") is not None

    def progress(self) -> dict | None:
        """The last run: request_id, target, done, and the number of pages that are done."""
        stored = self.store.get_state("export_progress")
        if stored is None:
            return None
        found = json.loads(stored)
        page = passes.checkpoint_of(self.store, f"export:{found['request_id']}")
        return {**found, "pages_done": page["done"] if page else found.get("pages_done", 0)}

    def _clear(self, request_id: str, path: str) -> None:
        for key in ("export_progress", "export_request", f"export:{request_id}_cursor", f"export_cancelled:{request_id}"):
            self.store.delete_state(key)
        self.store.remove_folder(self._folder(request_id))
        self.gateway.discard(path)

    def _folder(self, request_id: str) -> str:
        return f"{self.store.root}/_exports/{request_id}"

    def _stage(self, request_id: str) -> str:
        return f"{self._folder(request_id)}/parts"

    def _items(self, request_id: str) -> str:
        return f"{self._folder(request_id)}/items"

    def resume(self, path: str, blobs: DataFrame, now: str, *, direct: DataFrame | None = None) -> Result | None:
        """Goes on with the stored request, if one was begun and not finished; progress without a request is cleared."""
        progress, stored = self.progress(), self.store.get_state("export_request")
        if self.running or progress is None or progress["done"]:
            return None
        if stored is None:
            self.store.delete_state("export_progress")
            return None
        request = json.loads(stored)
        return self.run(path=path, blobs=blobs, direct=direct, **{**request, "now": request.get("now", now)})

    def path_in(self, folder: str, target: str, now: str) -> str:
        """Where a run of this target, begun now, goes in a folder."""
        ending = getattr(self.gateway, "ENDINGS", OneFile.ENDINGS)[target != "json"]
        name = self.spark.range(1).select(artifact_name(F.lit(target), F.lit(now), F.lit(ending))).first()[0]
        return f"{folder.rstrip('/')}/{name}"

    def run(self, *, request_id: str | None = None, target: str, path: str, blobs: DataFrame, now: str, inclusion: str = "link-local", incremental: bool = False, state: str | None = None, direct: DataFrame | None = None, page_rows: int = passes.PAGE_ROWS) -> Result:
        """Delivers the export at path. `now` is when the snapshot is taken and becomes the watermark, so that resources saved while the run
        goes on belong to the next one."""
        if target not in SERIALIZERS:
            raise KeyError(target)
        if self.running:
            raise RuntimeError("an export is running")
        self.running = True
        request_id = str(uuid.uuid4()) if request_id is None else request_id
        try:
            request = {"request_id": request_id, "target": target, "inclusion": inclusion, "incremental": incremental, "state": state, "now": now, "page_rows": page_rows}
            self.store.put_state("export_request", json.dumps(request))
            self.store.put_state("export_progress", json.dumps({"request_id": request_id, "target": target, "done": False}))
            return self._drive(path, blobs, direct, **request)
        except Exception as error:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            if not self._cancelled(request_id):
                raise
            self._clear(request_id, path)
            raise Cancelled(request_id) from error
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            self.running = False

    def _drive(self, path: str, blobs: DataFrame, direct: DataFrame | None, *, request_id: str, target: str, inclusion: str, incremental: bool, state: str | None, now: str, page_rows: int) -> Result:
        self.spark.sparkContext.setJobGroup(request_id, f"export {target}")
        before = self.manifest(target) if incremental else None
        later = above_watermark(F.col("source.extracted_at"), before["last_exported_at"] if before else None)

        def rows(snapshot: int) -> DataFrame:
            resources = self.store.read("resources", snapshot)
            return resources if state is None else resources.where(F.col("state") == state)

        def serialize(page: DataFrame, number: int) -> None:
            items = page.where(later)
            parts = json_lines(items, inclusion).select("id", "line") if target == "json" else SERIALIZERS[target](items, inclusion)
            parts.write.mode("overwrite").option("compression", "zstd").parquet(f"{self._stage(request_id)}/page={number}")

        name, stop = f"export:{request_id}", lambda: self._cancelled(request_id)
        begun = passes.checkpoint_of(self.store, name)
        snapshot = begun["snapshot"] if begun else self.store.latest_number()
        if begun is None:
            self.store.remove_folder(self._folder(request_id))
            if self._cancelled(request_id):
                raise Cancelled(request_id)
            facts = self.store.read("media_metadata", snapshot).where("state = 'complete'")
            ordered = present_media(rows(snapshot), facts, inclusion).repartitionByRange(shuffle_width(self.spark), "id").sortWithinPartitions("id")
            release(self.spark)  # what earlier writes exchanged
            ordered.write.mode("overwrite").option("compression", "zstd").parquet(self._items(request_id))
            release(self.spark)
        items = self.spark.read.parquet(self._items(request_id))
        report = passes.run_pass(self.store, name, lambda _: items, serialize, page_rows=page_rows, stop=stop, at=snapshot)
        if not report.completed_cleanly:
            raise RuntimeError(report.error)
        counts = items.agg(F.count_if(later).alias("exported"), F.count_if(~later).alias("skipped")).first()
        self.store.remove_folder(self._items(request_id))  # the artifact is put together from the parts; a run without a checkpoint begins anew
        parts, included, missing = self.spark.read.parquet(self._stage(request_id)), 0, 0
        if target == "json":
            size = self.gateway.lines(parts, path)
        else:
            there = blobs.select("media_id") if direct is None else blobs.select("media_id").union(direct.select("media_id"))
            media = parts.where("kind = 'binary'").join(there.distinct().withColumn("there", F.lit(True)).hint("merge"), "media_id", "left").agg(F.count_if(F.col("there")).alias("i"), F.count_if(F.col("there").isNull()).alias("m")).first()
            included, missing = media["i"], media["m"]
            size = self.gateway.archive(entries(parts, blobs, direct), path)
        if incremental:
            self.store.save("export_manifest", next_manifest(self.spark, before, target, request_id, counts["exported"], now))
        self.store.put_state("export_progress", json.dumps({"request_id": request_id, "target": target, "done": True, "pages_done": report.pages}))
        self.store.delete_state("export_request")
        self.store.remove_folder(self._folder(request_id))
        return Result(counts["exported"], counts["skipped"], included, missing, size, True)


def artifact_name(target: Column, at: Column, ending: Column) -> Column:
    """The file name of an export that was begun at an ISO time: its stamp sorts by time and has neither colons nor points."""
    return F.concat(F.lit(ARTIFACT_PREFIX), target, F.lit("-"), F.translate(at, ":.", "--"), F.lit("."), ending)


def next_manifest(spark: SparkSession, before, target: str, request_id: str, exported: int, now: str) -> DataFrame:
    """The manifest row after a delivered incremental run: totals grow, the creation time stays."""
    total, runs, created = (before["resources_exported_total"], before["export_count"], before["created_at"]) if before else (0, 0, now)
    return spark.createDataFrame([(target, now, request_id, total + exported, runs + 1, created, now)], schema.MANIFEST)
