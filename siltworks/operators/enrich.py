"""Enrichment: resources joined with their media's metadata, handled, classified and promoted; capture of media; text recognition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.operators import fetching

OUTCOMES = ("skipped", "failed", "missing", "ready")


def media_links(resources: DataFrame, include_children: bool = False) -> DataFrame:
    """resource_id, media_id, pos, type of each medium of a resource, own media only unless asked otherwise."""
    media = F.col("media")
    if include_children:
        media = F.concat(media, F.flatten(F.coalesce(F.transform("children", lambda c: c["media"]), F.array().cast(schema.MEDIA))))
    return resources.select(F.col("id").alias("resource_id"), F.posexplode(media).alias("pos", "m")).select("resource_id", F.col("m.id").alias("media_id"), "pos", F.col("m.type").alias("type"))


def resolve(links: DataFrame, metadata: DataFrame) -> DataFrame:
    """Per resource: a map of the metadata found, and whether any is absent. The join is on media_id; its result is aggregated per resource."""
    facts = metadata.select(F.col("id").alias("media_id"), F.struct(*metadata.columns).alias("meta"))
    joined = links.join(facts, "media_id", "left")
    found = F.collect_list(F.when(F.col("meta").isNotNull(), F.struct("media_id", "meta")))
    unique = F.array_distinct(found)
    return joined.groupBy("resource_id").agg(F.map_from_entries(unique).alias("resolved"), F.bool_or(F.col("meta").isNull()).alias("any_missing"))


def work_items(resources: DataFrame, metadata: DataFrame, *, state: str = "hydrated", include_children: bool = False) -> DataFrame:
    """Resources of a state with resolved media and a first outcome: skipped if their media are not complete, else missing or ready."""
    rows = resources.where(F.col("state") == state)
    found = resolve(media_links(rows.where("completeness.media"), include_children), metadata)
    rows = rows.join(found.withColumnRenamed("resource_id", "id"), "id", "left")
    ready = F.when(~F.coalesce(F.col("completeness.media"), F.lit(False)), "skipped").when(F.coalesce("any_missing", F.lit(False)), "missing").otherwise("ready")
    return rows.withColumn("outcome", ready).drop("any_missing")


#: Takes work items that are not skipped; gives id, error (null: none) and content blocks to add.
Handler = Callable[[DataFrame], DataFrame]


def run_pass(resources: DataFrame, metadata: DataFrame, handler: Handler | None = None, *, promote: bool = True, include_children: bool = False) -> tuple[DataFrame, DataFrame]:
    """Work items with their final outcome and, where it is ready, the promoted resource; and the one-row report.

    A failing handler makes the outcome failed, whether media are missing or not; missing media keep a resource as it is.
    """
    items = work_items(resources, metadata, include_children=include_children)
    if handler is None:
        items = items.withColumn("error", F.lit(None).cast("string")).withColumn("blocks", F.array().cast(schema.CONTENT))
    else:
        items = items.join(handler(items.where("outcome <> 'skipped'")).select("id", "error", "blocks"), "id", "left")
    items = items.withColumn("outcome", F.when((F.col("outcome") != "skipped") & F.col("error").isNotNull(), "failed").otherwise(F.col("outcome")))
    ready = (F.col("outcome") == "ready") & F.lit(promote)
    items = items.withColumn("state", F.when(ready, "enriched").otherwise(F.col("state")))
    items = items.withColumn("completeness", F.when(ready, F.col("completeness").withField("ocr", F.lit(True))).otherwise(F.col("completeness")))
    items = items.withColumn("content", F.when(ready, F.concat("content", F.coalesce("blocks", F.array().cast(schema.CONTENT)))).otherwise(F.col("content")))
    return items, report(items)


def report(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("enumerated"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        F.count_if(F.col("state") == "enriched").alias("enriched"),
    )


def fetchable(uri, kind):
    """Has an address that can be fetched, and is no video."""
    return F.coalesce((uri != "") & ~uri.startswith("data:") & ~uri.startswith("blob:"), F.lit(False)) & F.coalesce(kind != "video", F.lit(True))


MAX_BYTES = 20 * 1024 * 1024


def _nodes(resources: DataFrame) -> DataFrame:
    """resource_id, node_id (the resource itself or a child), pos, medium, of all media."""
    own = resources.select(F.col("id").alias("resource_id"), F.col("id").alias("node_id"), F.posexplode("media").alias("pos", "m"))
    kids = resources.select(F.col("id").alias("resource_id"), F.explode("children").alias("c")).select("resource_id", F.col("c.id").alias("node_id"), F.posexplode("c.media").alias("pos", "m"))
    return own.unionByName(kids)


def capture_plan(resources: DataFrame) -> DataFrame:
    """Media to fetch: resource_id, node_id, pos, media_id, source_uri, type, deferred (is not to be fetched)."""
    rows = _nodes(resources).select("resource_id", "node_id", "pos", F.col("m.id").alias("media_id"), F.col("m.source_uri").alias("source_uri"), F.col("m.type").alias("type"), F.col("m.local_uri").alias("local_uri"))
    return rows.withColumn("deferred", ~fetchable(F.col("source_uri"), F.col("type")))


def fetch(plan: DataFrame, transport: fetching.Transport, *, max_bytes: int = MAX_BYTES, per_host: int = 4) -> DataFrame:
    """Bytes of the planned media, by a transport that runs on the executors: ... content, error. One failure does not end the others."""
    return fetching.fetch(plan, transport, max_bytes=max_bytes, per_host=per_host)


def hydrate(resources: DataFrame, fetched: DataFrame, *, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Resources after capture, and per medium whether it is persisted, skipped or failed (and why).

    A node's media are complete if none is deferred, all candidates are persisted and all have a local address. A child with media that are
    complete is hydrated; a parent is, if it or a child has media and its own and all its children's are complete.
    """
    keys = ["resource_id", "node_id", "media_id"]
    sizes = fetched.select(*keys, F.length("content").alias("_size"), "error")  # only tasks that fetch hold bytes
    items = capture_plan(resources).join(sizes.dropDuplicates(keys), keys, "left")
    error = (
        F.when(F.col("deferred"), None)
        .when(F.col("_size").isNull(), F.coalesce("error", F.lit("No bytes returned")))
        .when(F.col("_size") > max_bytes, F.concat(F.lit("Too large: "), F.col("_size").cast("string"), F.lit(" bytes")))
    )
    items = items.withColumn("error", error).withColumn("result", F.when(F.col("deferred"), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("persisted"))
    items = items.withColumn("local_uri", F.when(F.col("result") == "persisted", F.concat(F.lit("media/"), F.col("media_id"))).otherwise(F.col("local_uri")))
    landed = (F.col("result") == "persisted") & F.col("local_uri").isNotNull()
    nodes = items.groupBy("resource_id", "node_id").agg(
        F.bool_and(landed).alias("complete"),
        F.map_from_entries(F.collect_list(F.struct("pos", F.struct("local_uri", F.when(F.col("result") == "persisted", F.col("_size").cast("long")).alias("size_bytes"))))).alias("by_pos"),
    )
    state = nodes.groupBy(F.col("resource_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("node_id", F.struct("complete", "by_pos")))).alias("nodes"))
    rows = resources.join(state, "id", "left")

    def media_of(media, node):
        def one(m, i):
            got = F.try_element_at(node["by_pos"], i)
            return m.withField("local_uri", F.coalesce(got["local_uri"], m["local_uri"])).withField("size_bytes", F.coalesce(got["size_bytes"], m["size_bytes"]))

        return F.transform(media, one)

    def child(c):
        node = F.try_element_at(F.col("nodes"), c["id"])
        complete = F.coalesce(node["complete"], F.size(c["media"]) == 0)
        after = c.withField("media", media_of(c["media"], node)).withField("completeness", c["completeness"].withField("media", complete))
        return after.withField("state", F.when(complete & (F.size(c["media"]) > 0), "hydrated").otherwise(c["state"]))

    own = F.try_element_at(F.col("nodes"), F.col("id"))
    rows = rows.withColumn("children", F.transform("children", child)).withColumn("_own", F.coalesce(own["complete"], F.size("media") == 0)).withColumn("media", media_of(F.col("media"), own))
    children = F.coalesce("children", F.array().cast(resources.schema["children"].dataType))
    some = (F.size("media") > 0) | F.exists(children, lambda c: F.size(c["media"]) > 0)
    done = F.col("_own") & F.forall(children, lambda c: c["completeness"]["media"])
    rows = rows.withColumn("state", F.when(some & done, "hydrated").otherwise(F.col("state"))).withColumn("completeness", F.col("completeness").withField("media", F.col("_own")))
    return rows.select(*resources.columns), items.select(*keys, "result", "error")


def recognize(images: DataFrame, engine: Callable[[], Callable[[bytes], str]]) -> DataFrame:
    """resource_id, media_id, text, error of images (resource_id, media_id, content): the engine is made once per task; text is trimmed, none if
    empty; an image that fails is recorded and the others go on."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for batch in batches:
            texts, errors = [], []
            for content in batch["content"]:
                try:
                    text, error = (read(bytes(content)) or "").strip() or None, None
                except Exception as e:  # noqa: BLE001 recorded per image
                    text, error = None, str(e) or type(e).__name__
                texts.append(text)
                errors.append(error)
            yield pd.DataFrame({"resource_id": batch["resource_id"], "media_id": batch["media_id"], "text": texts, "error": errors})

    return images.select("resource_id", "media_id", "content").mapInPandas(rows, "resource_id STRING, media_id STRING, text STRING, error STRING")


def ocr_handler(blobs: DataFrame, engine: Callable[[], Callable[[bytes], str]]) -> Handler:
    """A handler for run_pass: transcripts of the images whose bytes are there. blobs: media_id, content."""

    def handle(items: DataFrame) -> DataFrame:
        images = media_links(items).where("type = 'image'").join(blobs, "media_id")  # images without bytes are left out
        order = media_links(items).select("resource_id", "media_id", "pos")
        read = recognize(images, engine).where("text IS NOT NULL").join(order, ["resource_id", "media_id"])
        block = F.struct(F.lit("transcript").alias("type"), F.col("text").alias("value"), F.to_json(F.struct("media_id")).alias("metadata"))
        blocks = read.groupBy(F.col("resource_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
        return items.select("id").join(blocks, "id", "left").select("id", F.lit(None).cast("string").alias("error"), F.coalesce("blocks", F.array().cast(schema.CONTENT)).alias("blocks"))

    return handle
