"""From a parsed post to a resource."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.session import settle

from siltworks import schema
from siltworks.functions.text import djb2, given


def enrich(posts: DataFrame) -> DataFrame:
    """Distinct media in order of appearance; an unknown layout is inferred from them."""
    posts = posts.withColumn("media_uris", F.array_distinct(F.coalesce("media_uris", F.array().cast("array<string>"))))
    inferred = F.when(given(F.col("video_uri")), "reel").when(F.size("media_uris") > 1, "carousel").otherwise("single-image")
    return posts.withColumn("layout", F.when(F.col("layout") == "unknown", inferred).otherwise(F.col("layout")))


#: Slides that are walked through beyond the first.
ADVANCES = 20


def widen(posts: DataFrame, slides: Column, *, advances: int | None = None) -> DataFrame:
    """Media found while walking through the slides, after those known; with any new one the post is a carousel. `advances` ends the walk
    after the first slide and so many more."""
    known = F.col("media_uris")
    slides = slides if advances is None else F.slice(slides, 1, advances + 1)
    more = F.filter(F.array_distinct(slides), lambda u: ~F.array_contains(known, u))
    more = F.coalesce(more, F.array().cast("array<string>"))
    return posts.withColumn("layout", F.when(F.size(more) > 0, "carousel").otherwise(F.col("layout"))).withColumn("media_uris", F.concat(known, more))


def normalize(posts: DataFrame, extracted_at: Column) -> DataFrame:
    """One resource per post, as schema.RESOURCE says; extracted_at is ISO text. Other columns of posts are dropped."""
    c, ext = F.col, F.coalesce(F.col("external_id"), F.lit(""))
    fields = {f.name: f.dataType for f in schema.struct(schema.RESOURCE)}
    no = lambda kind="string": F.lit(None).cast(kind)
    complete = F.struct(F.lit(True).alias("thumbnail"), F.lit(True).alias("metadata"), F.lit(True).alias("media"), F.lit(False).alias("ocr"))

    def medium(media_id: Column, kind: Column, uri: Column) -> Column:
        return F.struct(media_id.alias("id"), kind.alias("type"), uri.alias("source_uri"), no().alias("local_uri"), no().alias("mime_type"), no("long").alias("size_bytes"))

    def source(external: Column, metadata: Column) -> Column:
        return F.struct(F.lit("instagram").alias("provider_name"), external.alias("external_id"), c("source_uri").alias("original_uri"), extracted_at.alias("extracted_at"), metadata.alias("metadata"))

    media = F.transform("media_uris", lambda u, i: medium(F.concat(ext, F.lit("_media_"), i.cast("string")), F.when(c("video_uri") == u, "video").otherwise("image"), u))

    def child(u: Column, i: Column) -> Column:
        part = F.concat(ext, F.lit("_slide_"), i.cast("string"))
        return F.struct(
            F.concat(F.lit("ig_"), part).alias("id"),
            F.lit("instagram-slide").alias("kind"),
            F.lit("extracted").alias("state"),
            source(part, no()).alias("source"),
            no(fields["author"]).alias("author"),
            F.array().cast(fields["content"]).alias("content"),
            F.array(medium(F.concat(F.lit("slide_media_"), i.cast("string")), F.lit("image"), u)).alias("media"),
            complete.alias("completeness"),
        )

    slides = F.transform(F.coalesce("slide_uris", "media_uris"), child)
    author = F.struct(no().alias("external_id"), c("author_handle").alias("handle"), F.when(given(c("author_display_name")), c("author_display_name")).alias("display_name"), no().alias("avatar_uri"), no().alias("profile_uri"))
    block = F.struct(F.lit("text").alias("type"), c("text_content").alias("value"), no().alias("metadata"))
    empty = lambda name: F.array().cast(fields[name])
    out = {
        "id": F.concat(F.lit("ig_"), F.when(given(ext), ext).otherwise(djb2(c("source_uri")))),
        "kind": F.when(c("layout") == "reel", "instagram-reel").otherwise("instagram-post"),
        "state": F.lit("extracted"),
        "source": source(F.coalesce("external_id", F.lit("unknown")), F.to_json(F.struct("layout"))),
        "author": F.when(given(c("author_handle")), author),
        "content": F.when(given(c("text_content")), F.array(block)).otherwise(empty("content")),
        "media": media,
        "children": F.when(c("layout") == "carousel", slides).otherwise(empty("children")),
        "completeness": complete,
    }
    return posts.select(*[x.cast(fields[n]).alias(n) for n, x in out.items()])


def adjacency(resources: DataFrame) -> DataFrame:
    """Resources and their children as rows: id, parent_id, child_pos, depth, kind, state, source, author, content, media, completeness.

    Each resource gives its rows in one step, so what the resources are made from is computed once."""
    own = ["id", "kind", "state", "source", "author", "content", "media", "completeness"]
    kinds = resources.schema
    null = lambda kind: F.lit(None).cast(kind)
    row = lambda parent, pos, depth, of: F.struct(parent.alias("parent_id"), pos.alias("child_pos"), F.lit(depth).alias("depth"), *[of(c).cast(kinds[c].dataType).alias(c) for c in own])
    root = row(null("string"), null("int"), 0, F.col)
    kids = F.transform("children", lambda child, i: row(F.col("id"), i, 1, lambda c: child[c]))
    rows = F.concat(F.array(root), F.coalesce(kids, F.filter(F.array(root), lambda _: F.lit(False))))
    return resources.select(F.explode(rows).alias("r")).select("r.parent_id", "r.child_pos", "r.depth", *[f"r.{c}" for c in own])


class Cycle(ValueError):
    """Parents that lead back to where they began."""


def descendants(edges: DataFrame) -> DataFrame:
    """id, ancestor, depth of all ancestors of each row of an adjacency table (id, parent_id), by doubling.

    Once the ancestors up to n steps away are known, those of the n-th ancestors are the ones up to 2n, so a tree takes as many rounds as
    the logarithm of its depth. In a tree no row is as deep as there are rows; where one is, Cycle is raised.
    """
    step = settle(edges.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth")))
    found, reach, n = step, 1, edges.count()
    while True:
        ends = found.where(F.col("depth") == reach).select("id", F.col("ancestor").alias("_at"))
        onward = found.select(F.col("id").alias("_at"), "ancestor", (F.col("depth") + reach).alias("depth"))
        more = settle(ends.join(onward, "_at").select("id", "ancestor", "depth"))
        if more.limit(1).count() == 0:
            return found
        if reach >= n:
            raise Cycle("parents form a cycle")
        found, reach = settle(found.unionByName(more)), 2 * reach


def tops(edges: DataFrame) -> DataFrame:
    """id, top, depth of each row of an adjacency table (id, parent_id): its last ancestor and how far it is; by pointer doubling, so that
    deep chains take few rounds and one row each. A parent without a row of its own is a top. Cycle is raised where parents lead in a circle."""
    inner = edges.where("parent_id is not null").select(F.col("id").alias("parent_id"), F.lit(False).alias("last"))
    state = edges.join(inner.distinct(), "parent_id", "left").select("id", F.coalesce("parent_id", "id").alias("top"), F.col("parent_id").isNotNull().cast("long").alias("depth"), F.coalesce("last", F.lit(True)).alias("last"))
    state, rounds = settle(state), max(1, edges.count()).bit_length() + 1
    for _ in range(rounds):
        open_rows = state.where("not last")
        if open_rows.limit(1).count() == 0:
            return state.drop("last")
        onward = state.select(F.col("id").alias("top"), F.col("top").alias("_top"), F.col("depth").alias("_more"), F.col("last").alias("_last"))
        moved = open_rows.join(onward, "top").select("id", F.col("_top").alias("top"), (F.col("depth") + F.col("_more")).alias("depth"), F.col("_last").alias("last"))
        state = settle(state.where("last").unionByName(moved))
    raise Cycle("parents form a cycle")
