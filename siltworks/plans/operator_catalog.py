"""More queries: operators called as such on rows made from the driver's tables, each with the SQL that says the same.

Importing this module adds them to the catalogue.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.functions import text as tx
from siltworks.operators import connector, dedup, enrich, extract, matching, metrics, normalize, ranges, scheduler
from siltworks.plans import export, gateways, passes
from siltworks.plans.catalog import QUERIES, SQL, WATERMARK, _djb2_sql, _items, _line_sql, _note_sql, _resources as _order_resources, _HERE, query
from siltworks.session import settle, shared_folder
from siltworks.sources import archive, blobs, media, sessions
from siltworks.sources.memory import MemoryStore
from siltworks.sources.store import Store
from siltworks.streaming import pipelines

SITE = "https://www.instagram.com/"
_ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z')"


def _key():
    return F.col("o_orderkey").cast("string")


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


# --- extraction, normalization ----------------------------------------------------------------------------------------------


def _pages(t):
    """Orders as captured pages: a full article, a reel, one with a relative link only, and one without a link."""
    who = F.col("o_custkey").cast("string")
    head = _text('<header><a href="/c', who, '/" role="link">c', who, "</a><span>Customer ", who, "</span></header>")
    caption = _text("<h1>", F.col("o_orderpriority"), "</h1>")
    post = _text("<article>", head, '<img src="/i/', _key(), '.png" width="640"><img src="/i/', _key(), '-b.png" width="640"><a href="/p/K', _key(), '/">p</a>', caption, '<time datetime="', tx.iso_millis(F.col("o_orderdate")), '"></time></article>')
    reel = _text("<article>", head, '<video src="/v/', _key(), '.mp4"></video><a href="/reel/R', _key(), '/?x=1">r</a></article>')
    plain = _text('<article><a href="p/D', _key(), '/">d</a><span> ', F.col("o_orderpriority"), " </span><span>", _key(), '</span><img src="/i/', _key(), '.png"></article>')
    bare = _text('<article>Order <img src="/i/', _key(), '.png">', _key(), "</article>")
    kind = F.col("o_orderkey") % 4
    return t("orders").select(F.col("o_orderkey").alias("page_id"), F.lit(SITE).alias("url"), F.when(kind == 0, post).when(kind == 1, reel).when(kind == 2, plain).otherwise(bare).alias("html"))


_POSTS = f"""SELECT o_orderkey AS page_id, o_orderkey % 4 AS c, '{SITE}' AS site, 'c' || o_custkey AS handle, 'Customer ' || o_custkey AS name, o_orderpriority AS body, {_ISO} AS published, o_orderkey::VARCHAR AS k FROM orders"""


@query(f"""SELECT page_id, CASE WHEN c < 2 THEN 'SemanticArticleStrategy' WHEN c = 2 THEN 'DataAttributeStrategy' ELSE 'StructuralHeuristicStrategy' END AS strategy,
CASE WHEN c < 2 THEN 0.85 WHEN c = 2 THEN 0.5 ELSE 0.2 END::DOUBLE AS confidence,
CASE c WHEN 0 THEN site || 'p/K' || k || '/' WHEN 1 THEN site || 'reel/R' || k || '/?x=1' WHEN 2 THEN site || 'p/D' || k || '/' ELSE site END AS source_uri,
CASE c WHEN 0 THEN 'K' || k WHEN 1 THEN 'R' || k WHEN 2 THEN 'D' || k END AS external_id, CASE WHEN c < 2 THEN handle END AS author_handle, CASE WHEN c < 2 THEN name END AS author_display_name,
CASE c WHEN 0 THEN body WHEN 2 THEN body || ' ' || k WHEN 3 THEN 'Order ' || k END AS text_content, CASE c WHEN 0 THEN 'carousel' WHEN 1 THEN 'reel' WHEN 2 THEN 'single-image' ELSE 'unknown' END AS layout,
CASE c WHEN 0 THEN 2 ELSE 1 END AS n_media, CASE WHEN c = 1 THEN site || 'v/' || k || '.mp4' END AS video_uri, CASE WHEN c = 0 THEN published END AS published_at FROM ({_POSTS})""")
def extract_posts(t):
    names = ("source_uri", "external_id", "author_handle", "author_display_name", "text_content", "layout", "video_uri", "published_at")
    return extract.extract(_pages(t)).select("page_id", "strategy", "confidence", *[F.col(f"post.{n}") for n in names], F.size("post.media_uris").alias("n_media"))


@query(f"""WITH p AS ({_POSTS}), hashed AS (SELECT {_djb2_sql(f"'{SITE}'")} AS h),
r AS (SELECT *, 'ig_' || CASE c WHEN 0 THEN 'K' || k WHEN 1 THEN 'R' || k WHEN 2 THEN 'D' || k ELSE h END AS id FROM p, hashed),
s AS (SELECT unnest([0, 1]) AS i)
SELECT id, NULL::VARCHAR AS parent_id, NULL::INT AS child_pos, 0 AS depth, CASE WHEN c = 1 THEN 'instagram-reel' ELSE 'instagram-post' END AS kind,
CASE WHEN c < 2 THEN handle END AS handle, CASE WHEN c < 3 THEN substr(id, 4) ELSE '' END || '_media_0' AS first_media, CASE WHEN c = 1 THEN 'video' ELSE 'image' END AS media_type, CASE WHEN c = 1 THEN '' ELSE 'text' END AS block FROM r
UNION ALL SELECT id || '_slide_' || i, id, i, 1, 'instagram-slide', NULL, 'slide_media_' || i, 'image', '' FROM r, s WHERE c = 0""")
def normalized_tree(t):
    found, _ = connector.resources(_pages(t), F.lit("2030-01-01T00:00:00.000Z"))
    tree = normalize.adjacency(found)
    return tree.select("id", "parent_id", "child_pos", "depth", "kind", F.col("author.handle").alias("handle"), F.col("media")[0]["id"].alias("first_media"), F.col("media")[0]["type"].alias("media_type"), F.coalesce(F.get("content", F.lit(0))["type"], F.lit("")).alias("block"))


@query(f"""SELECT page_id, CASE WHEN c = 0 THEN site || 'p/K' || k || '/' ELSE site || 'reel/R' || k || '/' END AS target_uri, CASE WHEN c < 2 THEN handle END AS author_handle,
CASE c WHEN 0 THEN 2 ELSE 0 END AS media_count FROM ({_POSTS}) WHERE c < 2""")
def discover_posts(t):
    return extract.discover(_pages(t)).select("page_id", "target_uri", "author_handle", "media_count")


_PAGE_LINKS = """SELECT page_id, unnest(range(len(hs))) AS pos, unnest(hs) AS h, origin FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs, regexp_extract(url, '^[a-z]+://[^/]+') AS origin FROM pages)"""


@query(f"""WITH l AS ({_PAGE_LINKS}), w AS (SELECT DISTINCT page_id + 1 AS page_id, origin || h AS uri, h AS path FROM l)
SELECT w.page_id, w.uri, min(l.pos)::INT AS pos, arg_min(l.origin || l.h, l.pos) AS href FROM w LEFT JOIN l ON l.page_id = w.page_id AND contains(l.origin || l.h, w.path) GROUP BY ALL""")
def linked_addresses(t):
    """The links of each page as wanted addresses on the next page."""
    found = settle(matching.places(t("pages"), "link"))
    return matching.first_match(found, found.select((F.col("page_id") + 1).alias("page_id"), F.col("href").alias("uri")))


@query(f"""WITH l AS ({_PAGE_LINKS}), w AS (SELECT DISTINCT 'https://wanted.example' || h AS uri, h AS path FROM l UNION ALL SELECT 'https://wanted.example', '/')
SELECT w.uri, min(struct_pack(a := l.page_id, b := l.pos)).a AS page_id, min(struct_pack(a := l.page_id, b := l.pos)).b::INT AS pos FROM w LEFT JOIN l ON contains(l.origin || l.h, w.path) GROUP BY ALL""")
def first_linking_page(t):
    """For each path that some page links to, and the root, the first link of all pages whose address holds it."""
    found = settle(matching.places(t("pages"), "link"))
    wanted = found.select(F.concat(F.lit("https://wanted.example"), tx.path_of(F.col("href"))).alias("uri")).unionByName(found.limit(1).select(F.lit("https://wanted.example").alias("uri")))
    return matching.first_match(found, wanted, by=(), order=("page_id", "pos")).select("uri", "page_id", "pos")


@query("""SELECT o_orderkey AS page_id, 0::INT AS seq, 'https://www.instagram.com/' || CASE o_orderkey % 4 WHEN 0 THEN 'p/G' WHEN 1 THEN 'reel/R' ELSE 'p/S' END || o_orderkey || '/' AS target_uri,
CASE o_orderkey % 4 WHEN 0 THEN 2 ELSE 1 END::INT AS media_count, CASE o_orderkey % 4 WHEN 3 THEN o_orderpriority END AS caption_preview FROM orders WHERE o_orderkey % 4 <> 2""")
def grid_posts(t):
    """Thumbnails of grids: links to posts with an image, neither in a header nor in an open dialog; articles do not count there."""
    link = lambda where, inside: _text('<a href="/', where, _key(), '/?x=1">', inside, "</a>")
    kind = F.col("o_orderkey") % 4
    shown = (
        F.when(kind == 0, link("p/G", "<img><img>"))
        .when(kind == 1, _text("<header>", link("p/H", "<img>"), "</header>", link("reel/R", "<img>")))
        .when(kind == 2, _text('<div role="dialog">', link("p/D", "<img>"), "</div><article>", link("p/A", "a"), "</article>"))
        .otherwise(_text(link("p/N", "no image"), link("p/S", _text("<span>", F.col("o_orderpriority"), "</span><img>"))))
    )
    pages = t("orders").select(F.col("o_orderkey").alias("page_id"), F.lit(SITE + "someone/").alias("url"), shown.alias("html"))
    return extract.discover(pages).select("page_id", "seq", "target_uri", "media_count", "caption_preview")


@query("""SELECT o_orderkey AS page_id, o_orderkey % 5 < 3 AS has_modal, CASE o_orderkey % 5 WHEN 0 THEN 'https://www.instagram.com/p/D' || o_orderkey || '/' WHEN 1 THEN 'https://www.instagram.com/reel/A' || o_orderkey || '/' END AS modal_uri,
CASE o_orderkey % 5 WHEN 0 THEN 'button' WHEN 1 THEN 'div' WHEN 3 THEN 'svg' END AS next_tag, CASE o_orderkey % 5 WHEN 0 THEN 'second' WHEN 1 THEN 'go ' || o_orderkey WHEN 3 THEN '' END AS next_text FROM orders""")
def open_dialogs(t):
    """Open post dialogs among other dialogs, and the control that leads to the next slide: a button, what holds an icon, or the icon."""
    key, kind = _key(), F.col("o_orderkey") % 5
    other = '<div role="dialog">cookies</div>'
    shown = (
        F.when(kind == 0, _text(other, '<div role="dialog"><a href="/p/D', key, '/">p</a></div><span aria-label="Next">first</span><button aria-label="Next">second</button>'))
        .when(kind == 1, _text(other, '<article role="presentation"><a href="/reel/A', key, '/">r</a></article><div role="button">go ', key, '<svg aria-label="Next"></svg></div>'))
        .when(kind == 2, _text('<div role="dialog"><article>', key, "</article></div>"))
        .when(kind == 3, _text(other, '<p>', key, '</p><svg aria-label="Next"></svg>'))
        .otherwise(_text(other, '<article><a href="/p/F', key, '/">not in a dialog</a></article>'))
    )
    return extract.controls(t("orders").select(F.col("o_orderkey").alias("page_id"), F.lit(SITE).alias("url"), shown.alias("html")))


@query("""WITH RECURSIVE up(id, ancestor, depth) AS (SELECT o_orderkey, o_orderkey // 2, 1 FROM orders WHERE o_orderkey > 1 AND o_orderkey // 2 IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT up.id, ancestor // 2, depth + 1 FROM up WHERE ancestor > 1 AND ancestor // 2 IN (SELECT o_orderkey FROM orders)) SELECT id, ancestor, depth FROM up""")
def all_ancestors(t):
    keys = t("orders").select(F.col("o_orderkey").alias("id"))
    parents = keys.withColumnRenamed("id", "parent_id")
    edges = keys.withColumn("up", F.when(F.col("id") > 1, F.floor(F.col("id") / 2))).join(parents, F.col("up") == F.col("parent_id"), "left").select("id", "parent_id")
    return normalize.descendants(edges)


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent_id FROM orders),
up(id, top, depth) AS (SELECT id, id, 0::BIGINT FROM o WHERE parent_id IS NULL UNION ALL SELECT o.id, up.top, up.depth + 1 FROM up JOIN o ON o.parent_id = up.id) SELECT * FROM up""")
def order_chains(t):
    """Each customer's orders as a chain; the first and the distance from it."""
    return normalize.tops(t("orders").select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("parent_id")))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Q' || o_orderkey WHEN 1 THEN 'r_-' || o_orderkey ELSE '' END AS external_id, CASE WHEN o_orderkey % 3 < 2 OR o_orderkey % 2 = 0 THEN 'instagram' END AS provider, o_orderkey % 3 < 2 AS on_surface FROM orders")
def routed_addresses(t):
    host = F.when(F.col("o_orderkey") % 2 == 0, "https://www.instagram.com").otherwise("https://example.org")
    path = F.when(F.col("o_orderkey") % 3 == 0, _text("/p/Q", _key(), "/")).when(F.col("o_orderkey") % 3 == 1, _text("/reel/r_-", _key(), "?p=/p/x")).otherwise(_text("/pages/", _key()))
    rows = t("orders").select(F.col("o_orderkey").alias("id"), F.concat(host, path).alias("url"))
    here = tx.is_on_surface(F.col("url"), F.lit(SITE + "someone/"))  # a grid: its own paths and permalinks
    return connector.gate(rows, "discovery").select("id", tx.external_id(F.col("url")).alias("external_id"), connector.route(F.col("url")).alias("provider"), here.alias("on_surface"))


# --- the store --------------------------------------------------------------------------------------------------------------


def _tasks(rows: DataFrame, state: str) -> DataFrame:
    fields = {"id": _key(), "target_uri": _key(), "state": F.lit(state), "priority": F.lit(1), "attempts": F.lit(0), "max_attempts": F.lit(3), "next_retry_at": F.lit(None), "last_error": F.lit(None), "seq": F.col("o_orderkey")}
    return rows.select(*[x.cast(schema.struct(schema.TASK)[n].dataType).alias(n) for n, x in fields.items()])


def stored_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits, an upsert with a key given twice, a removal and a transaction over two tables, read back from the store."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.save("tasks", _tasks(orders, "queued"))
    some = orders.where("o_orderkey % 3 = 0")
    store.save("tasks", _tasks(some, "opening").unionByName(_tasks(some, "opening")))
    store.remove("tasks", orders.where("o_orderkey % 5 = 0").select(_key().alias("target_uri")))
    change = store.transaction()
    change.put("tasks", _tasks(orders.where("o_orderkey % 7 = 0"), "failed"))
    change.delete("tasks", orders.where("o_orderkey % 14 = 0").select(_key().alias("target_uri")))
    change.put("control_state", spark.createDataFrame([("pass", "2")], schema.CONTROL_STATE))
    change.commit()
    return store.read("tasks").select("target_uri", "state", "seq", F.lit(store.get_state("pass")).alias("pass"))


QUERIES["stored_tasks"] = stored_tasks
SQL["stored_tasks"] = """SELECT o_orderkey::VARCHAR AS target_uri, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'opening' ELSE 'queued' END AS state, o_orderkey AS seq, '2' AS pass
FROM orders WHERE (o_orderkey % 5 <> 0 OR o_orderkey % 7 = 0) AND o_orderkey % 14 <> 0"""


def stored_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup and the count, by the store."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.save("tasks", _tasks(spark.read.parquet(f"{sf_dir}/orders.parquet"), "queued"))
    return store.get("tasks", "7").select("id", "state", "seq", F.lit(store.count("tasks")).alias("n_rows"))


QUERIES["stored_row"] = stored_row
SQL["stored_row"] = "SELECT o_orderkey::VARCHAR AS id, 'queued' AS state, o_orderkey AS seq, (SELECT count(*) FROM orders) AS n_rows FROM orders WHERE o_orderkey = 7"


@query("""SELECT o_orderkey::VARCHAR AS target_uri, CASE WHEN o_orderkey % 7 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'opening' ELSE 'queued' END AS state, o_orderkey AS seq
FROM orders WHERE (o_orderkey % 5 <> 0 OR o_orderkey % 7 = 0) AND o_orderkey % 14 <> 0""")
def memory_tasks(t):
    """The steps of stored_tasks without a folder, in a transaction that is rolled back, which undoes nothing here."""
    orders = t("orders")
    store = MemoryStore(orders.sparkSession)
    store.save("tasks", _tasks(orders, "queued"))
    some = orders.where("o_orderkey % 3 = 0")
    store.save("tasks", _tasks(some, "opening").unionByName(_tasks(some, "opening")))
    store.remove("tasks", orders.where("o_orderkey % 5 = 0").select(_key().alias("target_uri")))
    change = store.transaction()
    change.put("tasks", _tasks(orders.where("o_orderkey % 7 = 0"), "failed"))
    change.delete("tasks", orders.where("o_orderkey % 14 = 0").select(_key().alias("target_uri")))
    change.rollback()
    return store.read("tasks").select("target_uri", "state", "seq")


@query("SELECT 'c' || c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN 'kept' ELSE c_name END AS value, 2::BIGINT AS commits FROM customer WHERE c_custkey % 3 = 0 OR c_custkey % 5 <> 0")
def moved_state(t):
    """Old control values, a fifth of them null, moved into a store that has a third of the keys already; twice, of which the second time does nothing."""
    people = t("customer")
    store = Store(people.sparkSession, f"{shared_folder(people.sparkSession)}/store-{uuid.uuid4().hex}")
    key = _text("c", F.col("c_custkey").cast("string")).alias("key")
    store.save("control_state", people.where("c_custkey % 3 = 0").select(key, F.lit("kept").alias("value")))
    legacy = people.select(key, F.when(F.col("c_custkey") % 5 != 0, F.col("c_name")).alias("value"))
    store.move_legacy_state(legacy)
    store.move_legacy_state(legacy)
    return store.read("control_state").select("key", "value", F.lit(store.latest_number()).cast("long").alias("commits"))


@query("SELECT when_read, o_orderkey::VARCHAR AS target_uri, -(o_orderkey % 5)::INT AS priority, 'c' || o_custkey || ':' || (o_orderkey % 5) AS owner, 'queued' AS state FROM orders, (SELECT unnest(['before', 'after']) AS when_read)")
def migrated_rows(t):
    """Tasks written two schema versions ago, as they are read before and after the store is migrated."""
    orders = t("orders")
    old = "target_uri STRING, rank STRING, who BIGINT, state STRING"
    new = "target_uri STRING, priority INT, owner STRING, state STRING"
    steps = {
        3: schema.Step("numbers for ranks", {"tasks": {"priority": "cast(rank AS INT)", "rank": None}}),
        4: schema.Step("higher is sooner, owners", {"tasks": {"priority": "-priority", "owner": "concat('c', who, ':', priority)", "who": None}}),
    }
    root = f"{shared_folder(orders.sparkSession)}/store-{uuid.uuid4().hex}"
    Store(orders.sparkSession, root, tables={**schema.TABLES, "tasks": old}).commit("tasks", orders.select(_key().alias("target_uri"), (F.col("o_orderkey") % 5).cast("string").alias("rank"), F.col("o_custkey").alias("who"), F.lit("queued").alias("state")))
    store = Store(orders.sparkSession, root, tables={**schema.TABLES, "tasks": new}, steps={**schema.MIGRATIONS, **steps})
    before = store.read("tasks").select(F.lit("before").alias("when_read"), "*")
    store.migrate()
    return before.unionByName(store.read("tasks").select(F.lit("after").alias("when_read"), "*"))


# --- media ------------------------------------------------------------------------------------------------------------------


def _new_media(t):
    kind = F.when(F.col("doc_id") % 3 == 0, "image").when(F.col("doc_id") % 3 == 1, "video")
    return t("documents").select(F.col("doc_id").cast("string").alias("id"), kind.alias("type"), F.lit("x/y").alias("mime_type"), F.col("text").cast("binary").alias("content"), F.col("source"))


def _known_media(t):
    fields = schema.struct(schema.MEDIA_METADATA)
    old = {"id": F.col("doc_id").cast("string"), "created_at": F.lit("2020")}
    return t("labels").select(*[old.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).distinct()


_PATH = "'media/' || CASE doc_id % 3 WHEN 0 THEN 'images' WHEN 1 THEN 'videos' ELSE 'other' END || '/' || doc_id"


@query(f"SELECT doc_id::VARCHAR AS id, coalesce(CASE doc_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' END, 'unknown') AS type, octet_length(encode(text)) AS size_bytes, sha256(text) AS hash, {_PATH} AS storage_path, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN '2020' ELSE '2030' END AS created_at, '2030' AS last_access FROM documents")
def media_put(t):
    return media.put(_new_media(t), _known_media(t), "2030").select("id", "type", "size_bytes", "hash", "storage_path", "created_at", "last_access")


def _stored(t):
    """Blobs: some gone, some altered, some that nobody names, some unfinished."""
    rows = _new_media(t).select(F.col("id").cast("long").alias("n"), tx.blob_path(F.col("id"), F.coalesce("type", F.lit("unknown"))).alias("path"), "content").where("n % 5 <> 0")
    content = F.when(F.col("n") % 7 == 0, F.lit("altered").cast("binary")).otherwise(F.col("content"))
    extra = t("nation").select(F.when(F.col("n_nationkey") % 2 == 0, _text("media/images/stray", F.col("n_nationkey").cast("string"))).otherwise(_text("media/tmp/", F.col("n_nationkey").cast("string"))).alias("path"), F.lit("x").cast("binary").alias("content"))
    return rows.select("path", content.alias("content")).unionByName(extra)


@query("SELECT doc_id::VARCHAR AS id, doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS ok FROM documents")
def media_verify(t):
    return media.verify(media.put(_new_media(t), _known_media(t), "2030"), _stored(t))


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS orphan_metadata_removed, count(*) FILTER (n_nationkey % 2 = 0) AS orphan_blobs_removed, count(*) FILTER (n_nationkey % 2 = 1) AS tmp_removed FROM nation")
def cleanup_counts(t):
    return media.cleanup_report(media.put(_new_media(t), _known_media(t), "2030"), _stored(t))


@query("SELECT doc_id::VARCHAR AS id FROM documents WHERE doc_id % 5 = 0")
def metadata_without_bytes(t):
    return media.orphan_metadata(media.put(_new_media(t), _known_media(t), "2030"), _stored(t)).select("id")


@query("SELECT p_partkey::VARCHAR AS id, p_size::BIGINT AS size_bytes, CASE WHEN p_partkey % 2 = 0 THEN '5' ELSE '3' END AS last_access FROM part WHERE p_partkey % 4 < 2")
def sidecar_media(t):
    key = F.col("p_partkey").cast("string")
    state = F.when(F.col("p_partkey") % 4 == 2, "writing").otherwise("complete")
    whole = F.to_json(F.struct(key.alias("id"), F.col("p_size").cast("long").alias("size_bytes"), state.alias("state"), F.lit("3").alias("last_access")))
    texts = t("part").select(F.when(F.col("p_partkey") % 4 == 3, F.lit("{broken")).otherwise(whole).alias("value"))
    seen = t("part").where("p_partkey % 2 = 0").select(key.alias("id"), F.explode(F.array(F.lit("4"), F.lit("5"), F.lit("1"))).alias("at"))
    return media.with_last_access(media.read_sidecars(texts), seen).select("id", "size_bytes", "last_access")


_ADDRESS = "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'data:image/png;base64,' WHEN 3 THEN 'blob:https://x/' || o_orderkey ELSE 'https://x/' || o_orderkey END"


@query(f"SELECT o_orderkey::VARCHAR AS resource_id, 'm' || o_orderkey AS media_id, (o_orderkey % 5 <> 4 OR o_orderkey % 2 = 0) AS deferred, CASE WHEN o_orderkey % 10 = 9 AND o_orderkey % 3 <> 0 THEN length('https://x/' || o_orderkey) END AS got, CASE WHEN o_orderkey % 10 = 9 AND o_orderkey % 3 = 0 THEN 'no route' END AS error FROM orders")
def fetched_media(t):
    n = F.col("o_orderkey") % 5
    uri = F.when(n == 0, None).when(n == 1, "").when(n == 2, "data:image/png;base64,").when(n == 3, _text("blob:https://x/", _key())).otherwise(_text("https://x/", _key()))
    fields = {f.name: f.dataType for f in schema.struct(schema.RESOURCE)}
    one = F.struct(_text("m", _key()).alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "video").otherwise("image").alias("type"), uri.alias("source_uri"), F.lit(None).cast("string").alias("local_uri"), F.lit(None).cast("string").alias("mime_type"), F.lit(None).cast("long").alias("size_bytes"))
    made = {"id": _key(), "kind": F.lit("order"), "state": F.lit("extracted"), "media": F.array(one)}
    plan = enrich.capture_plan(t("orders").select(*[made.get(x, F.lit(None)).cast(k).alias(x) for x, k in fields.items()]))

    def transport(address: str) -> bytes:
        if int(address.rsplit("/", 1)[1]) % 3 == 0:
            raise OSError("no route")
        return address.encode()

    got = enrich.fetch(plan, transport).select("media_id", F.length("content").cast("long").alias("got"), "error")
    return plan.select("resource_id", "media_id", "deferred").join(got, "media_id", "left").select("resource_id", "media_id", "deferred", "got", "error")


def _medium(media_id, kind, uri):
    none = F.lit(None).cast("string")
    return F.struct(media_id.alias("id"), kind.alias("type"), uri.alias("source_uri"), none.alias("local_uri"), none.alias("mime_type"), F.lit(None).cast("long").alias("size_bytes"))


def _complete(media=None):
    return F.struct(F.lit(True).alias("thumbnail"), F.lit(True).alias("metadata"), (F.lit(True) if media is None else media).alias("media"), F.lit(False).alias("ocr"))


def _resources(rows, made):
    fields = {f.name: f.dataType for f in schema.struct(schema.RESOURCE)}
    return rows.select(*[made.get(x, F.lit(None)).cast(k).alias(x) for x, k in fields.items()])


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 = 0 OR o_orderkey % 4 <> 0 AS own_ok, o_orderkey % 3 = 0 AS kid, o_orderkey % 5 <> 0 AS kid_ok, o_orderkey % 7 <> 0 AS own FROM orders)
SELECT k::VARCHAR AS id, CASE WHEN (own OR kid) AND own_ok AND (NOT kid OR kid_ok) THEN 'hydrated' ELSE 'extracted' END AS state, own_ok AS media_complete,
CASE WHEN own THEN 'media/a' || k END AS first_local, CASE WHEN own THEN length('https://x/' || k || '/a') END AS first_bytes, CASE WHEN own AND k % 4 <> 0 THEN 'media/b' || k END AS second_local,
CASE WHEN kid THEN CASE WHEN kid_ok THEN 'hydrated' ELSE 'extracted' END END AS child_state, CASE WHEN kid AND kid_ok THEN 'media/c' || k END AS child_local FROM o""")
def hydrated_resources(t):
    """Resources after their media and those of their children were fetched: some have none, some a video, which is deferred, some a child whose medium fails."""
    n, uri = F.col("o_orderkey"), lambda what: _text("https://x/", _key(), "/" + what)
    own = F.array(_medium(_text("a", _key()), F.lit("image"), uri("a")), _medium(_text("b", _key()), F.when(n % 4 == 0, "video").otherwise("image"), uri("b")))
    kinds = {f.name: f.dataType for f in schema.struct(f"c {schema.CHILD}")["c"].dataType}
    child = {"id": _text("child", _key()), "kind": F.lit("slide"), "state": F.lit("extracted"), "content": F.array(), "media": F.array(_medium(_text("c", _key()), F.lit("image"), uri("c"))), "completeness": _complete()}
    kid = F.struct(*[child.get(x, F.lit(None)).cast(k).alias(x) for x, k in kinds.items()])
    made = {"id": _key(), "kind": F.lit("order"), "state": F.lit("extracted"), "completeness": _complete()}
    made |= {"media": F.when(n % 7 == 0, F.array().cast(schema.MEDIA)).otherwise(own), "children": F.when(n % 3 == 0, F.array(kid)).otherwise(F.array().cast(f"array<{schema.CHILD}>"))}
    rows = _resources(t("orders"), made)

    def transport(address: str) -> bytes:
        _, _, _, key, what = address.split("/")
        if what == "c" and int(key) % 5 == 0:
            raise OSError("no route")
        return address.encode()

    got, _ = enrich.hydrate(rows, enrich.fetch(enrich.capture_plan(rows), transport))
    first, second, c = F.get("media", F.lit(0)), F.get("media", F.lit(1)), F.get("children", F.lit(0))
    return got.select("id", "state", F.col("completeness.media").alias("media_complete"), first["local_uri"].alias("first_local"), first["size_bytes"].alias("first_bytes"), second["local_uri"].alias("second_local"), c["state"].alias("child_state"), F.get(c["media"], F.lit(0))["local_uri"].alias("child_local"))


@query("""SELECT id, outcome, CASE outcome WHEN 'ready' THEN 'enriched' ELSE 'hydrated' END AS state, CASE WHEN outcome = 'ready' AND d % 4 <> 1 AND d % 3 <> 0 AND n % 2 = 1 THEN n::VARCHAR END AS transcript FROM
(SELECT doc_id AS d, doc_id::VARCHAR AS id, octet_length(encode(text)) AS n, CASE WHEN doc_id % 7 = 0 THEN 'skipped' WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'ready' END AS outcome FROM documents)""")
def recognized_pass(t):
    """An enrichment pass whose handler reads images whose bytes are there, and fails for some: outcomes, promoted states, transcripts."""

    def engine():
        return lambda content: f" {len(content)} " if len(content) % 2 else ""

    docs, n, key = t("documents"), F.col("doc_id"), F.col("doc_id").cast("string")
    medium = _medium(_text("i", key), F.when(n % 4 == 1, "video").otherwise("image"), _text("https://x/", key))
    rows = _resources(docs, {"id": key, "kind": F.lit("doc"), "state": F.lit("hydrated"), "content": F.array(), "media": F.array(medium), "children": F.array(), "completeness": _complete(n % 7 != 0)})
    fields = schema.struct(schema.MEDIA_METADATA)
    known = docs.where("doc_id % 5 <> 0").select(*[(_text("i", key) if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    read = enrich.ocr_handler(docs.where("doc_id % 3 <> 0").select(_text("i", key).alias("media_id"), F.col("text").cast("binary").alias("content")), engine)
    items, _ = enrich.run_pass(rows, known, lambda i: read(i).withColumn("error", F.when(F.col("id").cast("long") % 11 == 0, "unreadable")))
    return items.select("id", "outcome", "state", F.get("content", F.lit(0))["value"].alias("transcript"))


@query("SELECT doc_id::VARCHAR AS resource_id, CASE WHEN doc_id % 10 <> 3 AND octet_length(encode(text)) % 4 <> 0 THEN octet_length(encode(text))::VARCHAR END AS text, CASE WHEN doc_id % 10 = 3 THEN 'unreadable' END AS error FROM documents")
def recognized_images(t):
    def engine():
        def read(content: bytes) -> str:
            if content.startswith(b"\xff"):
                raise ValueError("unreadable")
            return f" {len(content)} " if len(content) % 4 else "  "

        return read

    content = F.when(F.col("doc_id") % 10 == 3, F.lit(bytearray(b"\xff"))).otherwise(F.col("text").cast("binary"))
    images = t("documents").select(F.col("doc_id").cast("string").alias("resource_id"), F.lit("m").alias("media_id"), content.alias("content"))
    return enrich.recognize(images, engine).select("resource_id", "text", "error")


# --- queue, metrics, reports ------------------------------------------------------------------------------------------------


@query("SELECT 'u' || user_id AS target_uri, min(event_id) AS seq FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1")
def enqueued_first(t):
    known = t("customer").where("c_custkey % 2 = 0").select(_text("u", F.col("c_custkey").cast("string")).alias("target_uri"))
    return dedup.enqueue(known, t("events").select(_text("u", F.col("user_id").cast("string")).alias("target_uri"), F.col("event_id").alias("seq")))[0]


@query("SELECT count(*) - count(DISTINCT user_id) FILTER (user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)) AS duplicates FROM events")
def enqueue_duplicates(t):
    known = t("customer").where("c_custkey % 2 = 0").select(_text("u", F.col("c_custkey").cast("string")).alias("target_uri"))
    return dedup.enqueue(known, t("events").select(_text("u", F.col("user_id").cast("string")).alias("target_uri"), F.col("event_id").alias("seq")))[1]


_STAGE = "CASE event_id % 4 WHEN 0 THEN 'navigation' WHEN 1 THEN 'extraction' WHEN 2 THEN 'normalization' ELSE 'other' END"
_MESSAGE = "CASE event_id % 3 WHEN 0 THEN 'Page Not Found' WHEN 1 THEN 'no article element here' ELSE 'timeout' END"


def _failed(t):
    n = F.col("event_id")
    stage = F.when(n % 4 == 0, "navigation").when(n % 4 == 1, "extraction").when(n % 4 == 2, "normalization").otherwise("other")
    message = F.when(n % 3 == 0, "Page Not Found").when(n % 3 == 1, "no article element here").otherwise("timeout")
    return t("events").select("user_id", "event_id", "event_type", stage.alias("stage"), message.alias("message"))


@query(f"SELECT event_id, ({_STAGE} = 'navigation' AND event_id % 3 = 0) OR ({_STAGE} = 'extraction' AND event_id % 3 = 1) AS permanent FROM events")
def permanent_failures(t):
    return _failed(t).select("event_id", scheduler.is_permanent(F.col("stage"), F.col("message")).alias("permanent"))


def _records(t):
    shot = F.repeat(F.lit("<p>"), 900)
    rows = _failed(t).withColumn("category", scheduler.failure_category(F.col("stage"))).withColumn("root_cause", F.col("message")).withColumn("dom_snapshot", shot)
    rows = rows.withColumn("resource_uri", F.when(F.col("event_id") % 2 == 0, "").otherwise(_text("u", F.col("event_id").cast("string")))).withColumn("strategy", F.col("event_type"))
    return metrics.failures(rows, by=["user_id"], order=["event_id"])


_RECORDS = f"""SELECT user_id, count(*) AS n, 2000 AS longest, md5(string_agg(CASE WHEN event_id % 4 = 3 THEN 'unknown' ELSE {_STAGE} END || '|' || {_MESSAGE} || '|' || CASE WHEN event_id % 2 = 0 THEN '-' ELSE 'u' || event_id END || '|' || event_type, ';' ORDER BY event_id)) AS records FROM events GROUP BY user_id"""


@query(_RECORDS)
def failure_records(t):
    line = F.transform("failures", lambda f: F.concat_ws("|", f["category"], f["root_cause"], F.coalesce(f["resource_uri"], F.lit("-")), f["strategy"]))
    longest = F.array_max(F.transform("failures", lambda f: F.length(f["dom_snapshot"])))
    return _records(t).select("user_id", F.size("failures").cast("long").alias("n"), longest.alias("longest"), F.md5(F.array_join(line, ";")).alias("records"))


@query("SELECT c_custkey AS session_id, count(event_id) FILTER (event_type = 'view') AS views, CASE WHEN count(event_id) > 0 THEN count(event_id) END AS n_failures, CASE WHEN count(event_id) FILTER (event_type = 'click') > 0 THEN count(event_id) FILTER (event_type = 'click') END AS clicks FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def session_reports(t):
    sessions = t("customer").select(F.col("c_custkey").alias("session_id")).join(t("events").withColumnRenamed("user_id", "session_id"), "session_id", "left")
    counted = metrics.snapshot(sessions, by=["session_id"], counters={"views": "view"}, times={})
    report = metrics.session_report(counted, _records(t).withColumnRenamed("user_id", "session_id"), t("events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("strategy")))
    return report.select("session_id", F.col("metrics.views").alias("views"), F.size("failures").cast("long").alias("n_failures"), F.col("strategy_usage")["click"].alias("clicks")).withColumn("n_failures", F.when(F.col("n_failures") >= 0, F.col("n_failures")))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') > 0 AS any_discovered, count(*) FILTER (event_type = 'click') > 0 AS any_extracted, count(*) FILTER (event_type = 'purchase') > 0 AS any_persisted, count(DISTINCT event_type) FILTER (event_type IN ('view', 'click', 'purchase')) = 3 AS passed FROM events GROUP BY user_id")
def session_verdicts(t):
    counted = metrics.snapshot(t("events"), by=["user_id"], counters={"discovered": "view", "extracted": "click", "persisted": "purchase"}, times={})
    return metrics.smoke_verdict(counted, by=["user_id"])


# --- export -----------------------------------------------------------------------------------------------------------------

_LINK = f"'![image](' || CASE WHEN {_HERE} THEN 'media/' || o_orderkey || '_' || i ELSE 'https://example.com/' || o_orderkey || '/' || i END || ')'"
_MARKDOWN = _note_sql("''", _LINK)


@query(f"""SELECT id || '.md' AS path, note AS digest FROM ({_MARKDOWN})
UNION ALL SELECT 'media/' || o_orderkey || '_' || i, md5('bytes of ' || o_orderkey || '_' || i) FROM orders, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= o_orderkey % 4 AND i % 2 = 1 AND o_orderkey % 6 <> 1""")
def archive_entries(t):
    """Notes and the media whose bytes are there, as entries of an archive."""
    items = _items(t)
    blobs = items.where("cast(id AS BIGINT) % 6 <> 1").select(F.explode("media.id").alias("media_id")).withColumn("content", _text("bytes of ", F.col("media_id")).cast("binary"))
    return export.entries(export.markdown_parts(items, "link-local"), blobs).select("path", F.md5("content").alias("digest"))


_ENTRIES = f"""SELECT id || '.md' AS path, note AS content FROM ({_note_sql("''", _LINK, "concat")})
UNION ALL SELECT 'media/' || o_orderkey || '_' || i, 'bytes of ' || o_orderkey || '_' || i FROM orders, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= o_orderkey % 4 AND i % 2 = 1 AND o_orderkey % 6 <> 1"""


@query(f"SELECT row_number() OVER (ORDER BY encode(path)) - 1 AS place, path, octet_length(encode(content))::BIGINT AS size, md5(content) AS digest, true AS crc_holds FROM ({_ENTRIES})")
def zip_export(t):
    """An archive written by tasks and joined, read back entry by entry."""
    items = _items(t)
    spark = items.sparkSession
    blobs = items.where("cast(id AS BIGINT) % 6 <> 1").select(F.explode("media.id").alias("media_id")).withColumn("content", _text("bytes of ", F.col("media_id")).cast("binary"))
    target = f"{shared_folder(spark)}/{uuid.uuid4().hex}.zip"
    archive.write_archive(export.entries(export.markdown_parts(items, "link-local"), blobs), target)
    found = archive.read_archive(spark, target)
    return found.select("place", "path", "size", F.md5("content").alias("digest"), (F.crc32("content") == F.col("crc32")).alias("crc_holds"))


@query("SELECT (row_number() OVER (ORDER BY encode(o_orderpriority)) - 1)::BIGINT AS place, o_orderpriority AS path, md5(string_agg(o_orderkey || ';', '' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY o_orderpriority")
def appended_texts(t):
    """Texts of one path, appended in order to one entry of an archive."""
    rows = t("orders").select(F.lit("text").alias("kind"), F.col("o_orderpriority").alias("path"), F.col("o_orderkey").alias("id"), F.lit(0).alias("pos"), F.concat(_key(), F.lit(";")).alias("text"))
    target = f"{shared_folder(rows.sparkSession)}/{uuid.uuid4().hex}.zip"
    export.write_texts(rows, target)
    return archive.read_archive(rows.sparkSession, target).select("place", "path", F.md5("content").alias("digest"))


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN 'video' ELSE 'image' END AS type, octet_length(encode(x))::BIGINT AS size_bytes, sha256(x) AS hash, '1' AS created_at, CASE WHEN c_custkey % 3 = 0 THEN '2' ELSE '1' END AS last_access, md5(x) AS digest, true AS ok, 0::BIGINT AS removed
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' ELSE 'old ' END || c_name AS x FROM customer WHERE c_custkey % 5 <> 0)""")
def stored_blobs(t):
    """Bytes put into a folder, a third of them overwritten as another kind, a fifth deleted; then read, verified and cleaned."""
    people = t("customer")
    store = blobs.BlobStore(people.sparkSession, f"{shared_folder(people.sparkSession)}/{uuid.uuid4().hex}")
    new = lambda kind, word: people.select(F.col("c_custkey").cast("string").alias("id"), F.lit(kind).alias("type"), F.lit("x/y").alias("mime_type"), _text(word, F.col("c_name")).cast("binary").alias("content"), F.lit(None).cast("string").alias("source"))
    store.put(new("image", "old "), "1")
    store.put(new("video", "new ").where("cast(id AS BIGINT) % 3 = 0"), "2")
    store.delete(people.where("c_custkey % 5 = 0").select(F.col("c_custkey").cast("string").alias("id")))
    removed = store.clean().select(F.expr("orphan_metadata_removed + orphan_blobs_removed + tmp_removed").alias("removed"))
    stored = store.metadata().join(store.get(people.select(F.col("c_custkey").cast("string").alias("id"))), "id").join(store.verify(), "id")
    return stored.join(F.broadcast(removed)).select("id", "type", "size_bytes", "hash", "created_at", "last_access", F.md5("content").alias("digest"), "ok", "removed")


@query("""SELECT doc_id, md5(CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN '## ' || text WHEN 2 THEN '> ' || text WHEN 3 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 4 THEN '- ' || text ELSE '**[Transcript]**' || chr(10) || chr(10) || text END) AS block FROM documents""")
def rendered_blocks(t):
    """Whole texts as blocks of each kind."""
    kind = F.element_at(F.array(*map(F.lit, schema.BLOCKS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return t("documents").select("doc_id", F.md5(tx.render_block(kind, F.col("text"))).alias("block"))


@query(f"SELECT o_orderkey, 'knowledge-export-' || CASE o_orderkey % 3 WHEN 0 THEN 'json' WHEN 1 THEN 'markdown' ELSE 'obsidian' END || '-' || replace(replace({_ISO}, ':', '-'), '.', '-') || CASE WHEN o_orderkey % 3 = 0 THEN '.ndjson' ELSE '.zip' END AS name FROM orders")
def artifact_names(t):
    target = F.element_at(F.array(*map(F.lit, ("json", "markdown", "obsidian"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    ending = F.when(target == "json", export.OneFile.ENDINGS[0]).otherwise(export.OneFile.ENDINGS[1])
    return t("orders").select("o_orderkey", export.artifact_name(target, tx.iso_millis(F.col("o_orderdate")), ending).alias("name"))


def _exporting(t, gateway=None):
    """A coordinator over a store that holds orders as resources, and their odd media as complete."""
    items = _order_resources(t)
    spark = items.sparkSession
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    there = items.select(F.explode("media").alias("m")).where("cast(substring_index(m.id, '_', -1) AS INT) % 2 = 1")
    facts = {"id": F.col("m.id"), "type": F.lit("image"), "state": F.lit("complete")}
    store.save("media_metadata", there.select(*[facts.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.struct(schema.MEDIA_METADATA)]))
    return export.Coordinator(store, gateway), items


@query(f"WITH lines AS ({_line_sql('true', "''")}), o AS (SELECT o_orderkey::VARCHAR AS id, {_ISO} AS iso FROM orders) SELECT CASE WHEN iso > '{WATERMARK}' THEN 2 ELSE 1 END::INT AS run, line FROM lines JOIN o USING (id)")
def delivered_lines(t):
    """Two incremental runs that deliver folders of lines: the first before the later orders are there, the second of those only."""
    spark = t("orders").sparkSession
    run, items = _exporting(t, gateways.Folder(spark))
    later, no_blobs = export.above_watermark(F.col("source.extracted_at"), WATERMARK), spark.createDataFrame([], "media_id string, content binary")
    out = []
    for n, (rows, now) in enumerate(((items.where(~later), WATERMARK), (items.where(later), "2100-01-01T00:00:00.000Z")), 1):
        run.store.save("resources", rows)
        path = run.path_in(run.store.root, "json", now)
        run.run(target="json", path=path, blobs=no_blobs, now=now, inclusion="none", incremental=True)
        out.append(spark.read.text(path).select(F.lit(n).alias("run"), F.col("value").alias("line")))
    return out[0].unionByName(out[1])


_VAULT = _note_sql("'tags: [order, orders]' || chr(10) || 'kind: order' || chr(10)", f"CASE WHEN {_HERE} THEN '![[attachments/' || o_orderkey || '_' || i || ']]' ELSE '![image](https://example.com/' || o_orderkey || '/' || i || ')' END")


@query(f"""SELECT 'order/' || id || '.md' AS path, note AS digest FROM ({_VAULT})
UNION ALL SELECT 'attachments/' || o_orderkey || '_' || i, md5('bytes of ' || o_orderkey || '_' || i) FROM orders, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= o_orderkey % 4 AND i % 2 = 1""")
def delivered_vault(t):
    """A run over a store that delivers notes and attachments as an archive."""
    run, items = _exporting(t)
    run.store.save("resources", items)
    blobs = items.select(F.explode("media.id").alias("media_id")).withColumn("content", _text("bytes of ", F.col("media_id")).cast("binary"))
    path = run.path_in(run.store.root, "obsidian", WATERMARK)
    run.run(target="obsidian", path=path, blobs=blobs, now=WATERMARK)
    return archive.read_archive(run.spark, path).select("path", F.md5("content").alias("digest"))


@query("SELECT 'json' AS target, '2' AS last_exported_at, 'r2' AS last_request_id, (SELECT count(*) FROM orders) AS resources_exported_total, 2::BIGINT AS export_count, '1' AS created_at, '2' AS updated_at")
def export_manifest(t):
    orders = t("orders")
    first, second = (orders.where(w).count() for w in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"))
    before = export.next_manifest(orders.sparkSession, None, "json", "r1", first, "1").first()
    return export.next_manifest(orders.sparkSession, before, "json", "r2", second, "2")


@query("SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text)) AS n_bytes, sha256('data:text/plain;base64,' || to_base64(encode(text))) AS data_url FROM documents")
def whole_digests(t):
    url = export.data_url(F.col("text").cast("binary"), F.lit("text/plain"))
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(url, 256).alias("data_url"))


# --- pages, passes, sessions ------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 20 AS page_number FROM orders")
def numbered_pages(t):
    return ranges.page_numbers(t("orders").select("o_orderkey"), 20, key="o_orderkey")


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def last_events(t):
    return sessions.last_events(t("events"), seq="event_id").select("event_id", "event_type")


@query("SELECT event_id, CASE WHEN event_type = 'view' OR event_id % 3 = 0 THEN event_id + CASE WHEN event_type = 'view' THEN 1800000 ELSE 300000 END END AS due FROM events")
def next_passes(t):
    always = F.col("event_type") == "view"
    return t("events").select("event_id", passes.next_due(F.col("event_id"), F.when(always, 30).otherwise(5), F.col("event_id") % 3 == 0, always).alias("due"))


@query("SELECT o_custkey AS owner, least(count(*), 21)::INT AS n FROM orders GROUP BY 1")
def walked_slides(t):
    posts = t("orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("slides"))
    posts = posts.withColumn("media_uris", F.array().cast("array<string>")).withColumn("layout", F.lit("single-image"))
    return normalize.widen(posts, F.col("slides"), advances=normalize.ADVANCES).select("owner", F.size("media_uris").alias("n"))


@query("SELECT 'media/' || o_orderkey AS path, md5(CASE WHEN o_orderkey % 2 = 0 THEN 'fetched ' ELSE 'stored ' END || o_orderkey) AS digest FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def fetched_before_stored(t):
    """Media whose bytes were fetched for an archive come before those that are stored."""
    part = t("orders").select(_key().alias("id"), F.lit(1).alias("pos"), _text("media/", _key()).alias("path"), F.lit("binary").alias("kind"), F.lit(None).cast("string").alias("text"), _key().alias("media_id"))
    given = lambda word, n: t("orders").where(F.col("o_orderkey") % n == 0).select(_key().alias("media_id"), _text(word, _key()).cast("binary").alias("content"))
    return export.entries(part, given("stored ", 3), given("fetched ", 2)).select("path", F.md5("content").alias("digest"))


def paged_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pass over stored tasks that fails on its second page, and goes on there when it is run again: what each run handed over."""
    store = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.save("tasks", _tasks(spark.read.parquet(f"{sf_dir}/orders.parquet"), "queued"))
    n, broken, out = store.count("tasks"), [True], f"{store.root}/handed"

    def hand(page: DataFrame, number: int) -> None:
        if number == 1 and broken.pop():
            raise RuntimeError("interrupted")
        page.select("target_uri").write.mode("overwrite").parquet(f"{out}/page={number}")

    rows = lambda snapshot: store.read("tasks", snapshot)
    first = passes.run_pass(store, "tasks", rows, hand, key="target_uri", page_rows=max(1, n // 5))
    store.remove("tasks", store.read("tasks").select("target_uri"))  # the pass keeps to the rows that it began with
    broken.append(False)
    second = passes.run_pass(store, "tasks", rows, hand, key="target_uri", page_rows=max(1, n // 5))
    seen = spark.read.parquet(out).select("target_uri")
    resumed = not first.completed_cleanly and second.completed_cleanly and second.done_before == 1 and passes.checkpoint_of(store, "tasks") is None
    return seen.withColumn("resumed", F.lit(resumed))


QUERIES["paged_pass"] = paged_pass
SQL["paged_pass"] = "SELECT o_orderkey::VARCHAR AS target_uri, true AS resumed FROM orders"


def session_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all events, of which the least user's is started, synced and stopped; the counters are taken from the log."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kept = sessions.Sessions(Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"))
    user = events.agg(F.min("user_id")).first()[0]
    kept.start(str(user), "1")
    kept.sync(7, "2")
    kind = F.when(F.col("event_type") == "view", "discovered").otherwise(F.col("event_type"))
    kept.log.append(events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("session_id"), "ts", kind.alias("event_type"), "value", F.lit("").alias("payload")))
    kept.update("3", status="stopped")
    return kept.history().select("id", "status", "started_at", "updated_at", "queue_depth", F.get_json_object("metrics", "$.discovered").cast("long").alias("discovered"))


QUERIES["session_history"] = session_history
SQL["session_history"] = "SELECT user_id::VARCHAR AS id, 'stopped' AS status, '1' AS started_at, '3' AS updated_at, 7::BIGINT AS queue_depth, count(*) FILTER (event_type = 'view') AS discovered FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY 1"


# --- streams into the store -------------------------------------------------------------------------------------------------


def _streamed(t, rows: DataFrame, ddl: str, table: str, key: str, aggregate) -> DataFrame:
    """The table that a stream of rows (with a number n) keeps in a store: a third of them comes first, the rest, in two batches, after a restart."""
    spark = rows.sparkSession
    home = f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}"
    store = Store(spark, f"{home}/store")
    for part in range(3):
        rows.where(F.col("n") % 3 == part).drop("n").coalesce(1).write.mode("append").parquet(f"{home}/in")
        if part != 1:
            stream = pipelines.read_stream(spark, f"{home}/in", ddl, files_per_batch=1)
            pipelines.into_store(aggregate(stream), store, table, key, table, f"{home}/checkpoint").awaitTermination()
    return store.read(table)


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS discovered, count(*) FILTER (event_type = 'click') AS extracted, count(*) FILTER (event_type = 'purchase') AS persisted FROM events GROUP BY user_id")
def streamed_counters(t):
    """Session counters that a stream keeps up to date in the store."""
    kind = F.element_at(F.create_map(*map(F.lit, ("view", "discovered", "click", "extracted", "purchase", "persisted"))), F.col("event_type"))
    rows = t("events").select("user_id", F.coalesce(kind, F.lit("other")).alias("event_type"), F.col("event_id").alias("n"))
    kept = _streamed(t, rows, "user_id BIGINT, event_type STRING", "counters", "user_id", lambda s: pipelines.live_counters(s, "user_id"))
    return kept.select("user_id", "discovered", "extracted", "persisted")


@query("SELECT 'u' || user_id AS target_uri, count(*) AS seen, count(*) - 1 AS duplicates FROM events GROUP BY user_id")
def streamed_duplicates(t):
    """How often each address was handed in, kept by a stream in the store."""
    rows = t("events").select(_text("u", F.col("user_id").cast("string")).alias("target_uri"), F.col("event_id").alias("n"))
    return _streamed(t, rows, "target_uri STRING", "queue_counts", "target_uri", pipelines.queue_counts)
