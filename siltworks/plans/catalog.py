"""The operators on the driver's tables, each with the SQL that says the same.

The tables stand in for the engine's own: orders for resources (status as state, key as id) or tasks, line items for media, customers and
documents for media files, events for the event log, pages for captured pages, conversations for parents with children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.functions import text as tx
from siltworks.operators import dedup, enrich, extract, metrics, normalize, retention, scheduler
from siltworks.plans import export
from siltworks.sources import media, store
from siltworks.streaming import pipelines

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function (table reader) -> DataFrame under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# --- scans, pages, watermarks -----------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS state, count(*) AS n, grouping(o_orderstatus)::INT AS is_total FROM orders GROUP BY ROLLUP (o_orderstatus)")
def state_counts(t):
    return metrics.state_counts(t("orders").select(F.col("o_orderstatus").alias("state"))).withColumn("is_total", F.col("is_total").cast("int"))


def _page(df):
    return df.select("id", "total", "has_more", "next_cursor")


_PAGE = """WITH ahead AS (SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE {where} ORDER BY 1 LIMIT 21),
p AS (SELECT * FROM ahead ORDER BY id LIMIT 20), c AS (SELECT count(*) > 20 AS m FROM ahead)
SELECT id, total, m AS has_more, CASE WHEN m THEN (SELECT max(id) FROM p) END AS next_cursor FROM p, c"""


def _orders(t):
    return t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_totalprice").alias("total"))


@query(_PAGE.format(where="o_orderkey > 100"))
def page_all(t):
    return _page(store.query_page(_orders(t), 20, cursor=100))


@query(_PAGE.format(where="o_orderstatus = 'F' AND o_orderkey > 77"))
def page_by_state(t):
    return _page(store.query_page(_orders(t), 20, state="F", cursor=77))


@query("SELECT o_orderkey AS id, o_custkey AS owner FROM orders WHERE o_orderkey = 42")
def point_lookup(t):
    return t("orders").where(F.col("o_orderkey") == 42).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"))


_ISO = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z')"
WATERMARK = "1996-06-30T00:00:00.000Z"


@query(f"SELECT o_orderkey AS id, {_ISO} AS extracted_at FROM orders WHERE {_ISO} > '{WATERMARK}'")
def incremental_delta(t):
    rows = t("orders").select(F.col("o_orderkey").alias("id"), tx.iso_millis(F.col("o_orderdate")).alias("extracted_at"))
    return rows.where(export.above_watermark(F.col("extracted_at"), WATERMARK))


@query(f"SELECT count(*) FILTER ({_ISO} > '{WATERMARK}') AS exported, count(*) FILTER ({_ISO} <= '{WATERMARK}') AS skipped FROM orders")
def incremental_totals(t):
    later = export.above_watermark(tx.iso_millis(F.col("o_orderdate")), WATERMARK)
    return t("orders").agg(F.count_if(later).alias("exported"), F.count_if(~later).alias("skipped"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS state FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT -n_nationkey - 1, 'new' FROM nation")
def transaction_result(t):
    old = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    row = lambda i, s: F.struct(i.alias("id"), s.alias("state")).alias("row")
    op = lambda df, seq, kind, i, s: df.select(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), i.alias("id"), row(i, s))
    new = (-F.col("n_nationkey") - 1).cast("long")
    operations = op(t("nation"), 1, "put", new, F.lit("new"))
    operations = operations.unionByName(op(old.where("id % 7 = 0"), 2, "put", F.col("id"), F.lit("gone")))
    operations = operations.unionByName(op(old.where("id % 5 = 0"), 3, "put", F.col("id"), F.lit("X")))
    operations = operations.unionByName(op(old.where("id % 7 = 0"), 4, "delete", F.col("id"), F.col("state")))
    return store.apply_operations(old, operations, "id")


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_version(t):
    return store.latest(t("events").select("user_id", "event_type", "event_id"), "user_id", F.col("event_id"))


# --- media ------------------------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag AS kind, count(*) AS media_count, sum(l_quantity)::BIGINT AS total_bytes, grouping(l_returnflag)::INT AS is_total FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def media_statistics(t):
    found = media.statistics(t("lineitem"), "l_returnflag", F.col("l_quantity").cast("long"))
    return found.withColumn("is_total", F.col("is_total").cast("int"))


def _resources(t):
    """Orders as resources with up to three media; their line items as the media that are there."""
    orders = t("orders")
    key = F.col("o_orderkey").cast("string")
    no = F.lit(None).cast("string")
    number = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.sequence(F.lit(1).cast("bigint"), F.col("o_orderkey") % 4))
    medium = lambda i: F.struct(F.concat(key, F.lit("_"), i.cast("string")).alias("id"), F.lit("image").alias("type"), F.concat(F.lit("https://example.com/"), key, F.lit("/"), i.cast("string")).alias("source_uri"), no.alias("local_uri"), no.alias("mime_type"), F.lit(None).cast("long").alias("size_bytes"))
    complete = F.struct(F.lit(True).alias("thumbnail"), F.lit(True).alias("metadata"), (F.col("o_orderkey") % 7 != 0).alias("media"), F.lit(False).alias("ocr"))
    source = F.struct(F.lit("orders").alias("provider_name"), key.alias("external_id"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("https://example.com/o/"), key)).alias("original_uri"), tx.iso_millis(F.col("o_orderdate")).alias("extracted_at"), no.alias("metadata"))
    fields = {f.name: f.dataType for f in schema.struct(schema.RESOURCE)}
    author = F.struct(no.alias("external_id"), F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("handle"), no.alias("display_name"), no.alias("avatar_uri"), no.alias("profile_uri"))
    content = F.array(F.struct(F.lit("text").alias("type"), F.col("o_orderpriority").alias("value"), no.alias("metadata")))
    out = {"id": key, "kind": F.lit("order"), "state": F.when(F.col("o_orderstatus") == "F", "hydrated").otherwise("extracted"), "source": source, "author": author, "content": content, "media": F.transform(number, medium), "children": F.lit(None), "completeness": complete}
    return orders.select(*[x.cast(fields[n]).alias(n) for n, x in out.items()])


def _metadata(t):
    return t("lineitem").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("id")).distinct()


_LINKS = """links AS (SELECT o_orderkey, o_orderkey::VARCHAR || '_' || i AS media_id FROM (SELECT o_orderkey, unnest(range(1, o_orderkey % 4 + 1)) AS i FROM orders)),
there AS (SELECT DISTINCT l_orderkey::VARCHAR || '_' || l_linenumber AS media_id FROM lineitem)"""
_OUTCOMES = f"""WITH {_LINKS},
gaps AS (SELECT o_orderkey, bool_or(there.media_id IS NULL) AS gap FROM links LEFT JOIN there USING (media_id) GROUP BY 1),
outcomes AS (SELECT o.o_orderkey::VARCHAR AS id, CASE WHEN o.o_orderkey % 7 = 0 THEN 'skipped' WHEN gap THEN 'missing' ELSE 'ready' END AS outcome
  FROM orders o LEFT JOIN gaps g ON g.o_orderkey = o.o_orderkey WHERE o_orderstatus = 'F')"""


@query(f"{_OUTCOMES} SELECT id, outcome, CASE WHEN outcome = 'ready' THEN 'enriched' ELSE 'hydrated' END AS state FROM outcomes")
def reconcile_media(t):
    return enrich.run_pass(_resources(t), _metadata(t))[0].select("id", "outcome", "state")


@query(f"{_OUTCOMES} SELECT count(*) AS enumerated, count(*) FILTER (outcome = 'skipped') AS skipped, 0 AS failed, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'ready') AS ready, count(*) FILTER (outcome = 'ready') AS enriched FROM outcomes")
def reconciliation_report(t):
    return enrich.run_pass(_resources(t), _metadata(t))[1]


@query("SELECT c_custkey::VARCHAR AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_metadata(t):
    facts = t("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").cast("string").alias("storage_path"))
    return media.orphan_metadata(facts, t("orders").select(F.col("o_custkey").cast("string").alias("path"))).select("id")


@query("SELECT doc_id::VARCHAR AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def orphan_blobs(t):
    facts = t("labels").select(F.col("doc_id").cast("string").alias("storage_path"), F.when(F.col("quality") == 1, "complete").otherwise("writing").alias("state"))
    return media.orphan_blobs(t("documents").select(F.col("doc_id").cast("string").alias("path")), facts)


def _eviction(t):
    per = t("lineitem").groupBy(F.col("l_orderkey").alias("media_id")).agg(F.sum("l_quantity").cast("long").alias("size_bytes"), tx.iso_millis(F.max("l_shipdate")).alias("last_access"), F.when(F.max("l_linenumber") == 7, "video").otherwise("image").alias("type"))
    owner = t("orders").select(F.col("o_orderkey").alias("resource_id"), F.when(F.col("o_orderstatus") == "F", "enriched").when(F.col("o_orderstatus") == "O", "exported").otherwise("hydrated").alias("state"), F.col("o_orderkey").alias("media_id"))
    pins = t("orders").where("o_orderkey % 11 = 0").select(F.col("o_orderkey").alias("resource_id"))
    return per, owner, pins


_EVICTION = """WITH m AS (SELECT l_orderkey AS media_id, sum(l_quantity)::BIGINT AS size_bytes, strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S.000Z') AS last_access, CASE WHEN max(l_linenumber) = 7 THEN 'video' ELSE 'image' END AS type FROM lineitem GROUP BY 1),
d AS (SELECT m.*, CASE WHEN type = 'video' THEN 'retained_video' WHEN o_orderkey IS NULL OR o_orderstatus NOT IN ('F', 'O') THEN 'not_enriched' WHEN o_orderkey % 11 = 0 THEN 'pinned' ELSE 'evictable' END AS decision FROM m LEFT JOIN orders ON o_orderkey = media_id),
f AS (SELECT *, coalesce(sum(CASE WHEN decision = 'evictable' THEN size_bytes ELSE 0 END) OVER (ORDER BY last_access, media_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed_before FROM d),
b AS (SELECT sum(size_bytes)::BIGINT AS total, greatest(0, sum(size_bytes) - 100000)::BIGINT AS over FROM m)"""


@query(f"{_EVICTION} SELECT media_id, size_bytes, last_access FROM f, b WHERE decision = 'evictable' AND freed_before < over")
def lru_evict(t):
    return retention.plan(*_eviction(t), max_bytes=100_000, retain_video=True)[0].where("evicted").select("media_id", "size_bytes", "last_access")


@query(
    f"""{_EVICTION}, i AS (SELECT f.*, decision = 'evictable' AS e FROM f, b WHERE freed_before < over)
SELECT count(*) AS media_inspected, count(*) FILTER (e) AS media_evicted, coalesce(sum(size_bytes) FILTER (e), 0)::BIGINT AS bytes_freed,
count(*) FILTER (decision = 'retained_video') AS skipped_retained_video, count(*) FILTER (decision = 'not_enriched') AS skipped_not_enriched, count(*) FILTER (decision = 'pinned') AS skipped_pinned,
(SELECT total FROM b) AS bytes_before, greatest(0, (SELECT total FROM b) - coalesce(sum(size_bytes) FILTER (e), 0))::BIGINT AS bytes_after, (SELECT over = 0 FROM b) AS skipped_under_cap FROM i"""
)
def lru_report(t):
    return retention.plan(*_eviction(t), max_bytes=100_000, retain_video=True)[1]


@query("SELECT DISTINCT o_orderkey AS media_id FROM orders WHERE o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def present_semi_join(t):
    links = t("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("media_id"))
    return links.join(t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("media_id")), "media_id", "left_semi")


@query(f"""WITH {_LINKS}, n AS (SELECT l_orderkey::VARCHAR || '_' || l_linenumber AS media_id, min(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT links.media_id, CASE WHEN q IS NULL THEN 'failed' WHEN q > 40 THEN 'failed' ELSE 'persisted' END AS result, CASE WHEN q IS NULL THEN 'No bytes returned' WHEN q > 40 THEN 'Too large: ' || q::INT || ' bytes' END AS error FROM links LEFT JOIN n USING (media_id)""")
def capture_results(t):
    item = F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    got = t("lineitem").groupBy(item.alias("media_id"), F.col("l_orderkey").cast("string").alias("resource_id")).agg(F.min("l_quantity").cast("int").alias("q"))
    got = got.select("resource_id", F.col("resource_id").alias("node_id"), "media_id", F.repeat(F.lit("x"), F.col("q")).cast("binary").alias("content"), F.lit(None).cast("string").alias("error"))
    return enrich.hydrate(_resources(t), got, max_bytes=40)[1].select("media_id", "result", "error")


# --- queue and metrics ------------------------------------------------------------------------------------------------------


def _tasks(t):
    tasks = scheduler.new_tasks(t("orders").select(F.col("o_orderkey").cast("string").alias("target_uri"), F.col("o_orderkey").alias("seq"), "o_orderpriority", "o_orderstatus"))
    rank = t("orders").select(F.col("o_orderkey").cast("string").alias("id"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "opening").otherwise("completed").alias("state"), F.when(F.col("o_orderkey") % 2 == 0, 5000).cast("long").alias("next_retry_at"))
    return tasks.drop("priority", "state", "next_retry_at").join(rank, "id")


@query("SELECT o_orderkey::VARCHAR AS id, 5 - substr(o_orderpriority, 1, 1)::INT AS priority FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 1 ORDER BY priority DESC, o_orderkey LIMIT 1")
def next_task(t):
    return scheduler.next_task(_tasks(t), 4999).select("id", "priority")


@query("SELECT count(*) FILTER (o_orderstatus IN ('O', 'P')) AS queue_depth, count(*) FILTER (o_orderstatus IN ('O', 'P')) = 0 AS drained FROM orders")
def restored_depth(t):
    return scheduler.depth(scheduler.restore(_tasks(t)))


@query(
    """SELECT event_id, user_id, attempt, CASE WHEN attempt < 3 THEN (1000 * 2 ** (attempt - 1))::BIGINT ELSE -1 END AS delay_ms,
CASE WHEN attempt < 3 THEN epoch_us(ts) // 1000 + (1000 * 2 ** (attempt - 1))::BIGINT ELSE -1 END AS next_retry_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events WHERE event_type = 'error') WHERE attempt <= 3"""
)
def retry_schedule(t):
    failed = t("events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    found = scheduler.retry_schedule(failed, task="user_id", at="ts", tie="event_id").drop("ts")
    return found.fillna(-1, ["delay_ms", "next_retry_at"])


_COUNTERS = {"navigations": "view", "extracted": "click", "persisted": "purchase", "failures": "error"}
_TIMES = {"navigation": "view", "persistence": "purchase"}


@query(
    """SELECT user_id, count(*) FILTER (event_type = 'view') AS navigations, count(*) FILTER (event_type = 'click') AS extracted, count(*) FILTER (event_type = 'purchase') AS persisted, count(*) FILTER (event_type = 'error') AS failures,
coalesce(sum(v) FILTER (event_type = 'view'), 0)::DOUBLE AS navigation_ms_total, CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN floor((sum(v) FILTER (event_type = 'view'))::DOUBLE / count(*) FILTER (event_type = 'view') * 10 + 0.5) / 10 ELSE 0 END AS navigation_ms_average,
coalesce(sum(v) FILTER (event_type = 'purchase'), 0)::DOUBLE AS persistence_ms_total, CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN floor((sum(v) FILTER (event_type = 'purchase'))::DOUBLE / count(*) FILTER (event_type = 'purchase') * 10 + 0.5) / 10 ELSE 0 END AS persistence_ms_average,
epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS duration_ms
FROM (SELECT *, value::DECIMAL(18, 2) AS v FROM events) GROUP BY user_id"""
)
def session_metrics(t):
    events = t("events").withColumn("value", F.col("value").cast("decimal(18,2)"))  # sums of decimals do not depend on their order
    found = metrics.snapshot(events, by=["user_id"], counters=_COUNTERS, times=_TIMES)
    return found.withColumns({c: F.col(c).cast("double") for c in ("navigation_ms_total", "persistence_ms_total")})


_DELTA = "CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'purchase' THEN -1 ELSE 0 END"


@query(f"SELECT user_id, max(d)::BIGINT AS peak_queue_depth FROM (SELECT user_id, sum({_DELTA}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) GROUP BY user_id")
def peak_queue(t):
    return metrics.peak_depth(t("events").withColumn("delta", F.expr(_DELTA)), by=["user_id"], order=["ts", "event_id"])


@query(
    """SELECT user_id, max(n)::BIGINT >= 3 AS finished FROM (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS n
FROM (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)) GROUP BY user_id"""
)
def idle_sessions(t):
    streaks = scheduler.empty_streaks(t("events"), session="user_id", order=["ts", "event_id"], found=F.col("event_type") == "signup")
    return scheduler.is_idle(streaks, session="user_id")


_STAGE = "CASE event_type WHEN 'view' THEN 'navigation' WHEN 'click' THEN 'extraction' WHEN 'signup' THEN 'normalization' ELSE 'persistence' END"


@query(f"SELECT CASE WHEN s IN ('navigation', 'extraction', 'normalization') THEN s ELSE 'unknown' END AS category, count(*) AS n FROM (SELECT {_STAGE} AS s FROM events) GROUP BY 1")
def failure_histogram(t):
    found = metrics.histogram(t("events").select(scheduler.failure_category(F.expr(_STAGE)).alias("category")), "category")
    return found.select(F.explode("histogram").alias("category", "n"))


@query("SELECT event_type AS strategy, count(*) AS n FROM events GROUP BY 1")
def strategy_usage(t):
    return metrics.histogram(t("events").select(F.col("event_type").alias("strategy")), "strategy").select(F.explode("histogram").alias("strategy", "n"))


@query("SELECT count(*) FILTER (event_type = 'view') > 0 AS any_discovered, count(*) FILTER (event_type = 'click') > 0 AS any_extracted, count(*) FILTER (event_type = 'none') > 0 AS any_persisted, false AS passed FROM events")
def smoke_verdict(t):
    n = t("events").agg(*[F.count_if(F.col("event_type") == e).alias(c) for c, e in (("discovered", "view"), ("extracted", "click"), ("persisted", "none"))])
    return metrics.smoke_verdict(n)


# --- text, urls, duplicates -------------------------------------------------------------------------------------------------


@query("SELECT min(doc_id) AS doc_id, md5(text) AS digest FROM documents GROUP BY text")
def exact_dedup(t):
    return dedup.first_per_key(t("documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


def _djb2_sql(x: str) -> str:
    return f"printf('%08x', list_reduce(list_prepend(5381::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 33 + c) % 4294967296))"


@query(f"SELECT page_id, {_djb2_sql('url')} AS hash, {_djb2_sql("url || '|a|' || page_id || '|' || substr(url, 1, 64)")} AS fingerprint FROM pages")
def fingerprint(t):
    url = F.col("url")
    return t("pages").select("page_id", tx.djb2(url).alias("hash"), tx.fingerprint(url, F.lit("a"), F.col("page_id"), url).alias("fingerprint"))


_PATH = r"CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END"


@query(rf"SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || {_PATH} AS clean_url, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host FROM pages")
def clean_url(t):
    return t("pages").select("page_id", tx.clean_url(F.col("url")).alias("clean_url"), tx.host_of(F.col("url")).alias("host"))


_RESERVED = ", ".join(f"'{x}'" for x in tx.RESERVED)


@query(
    rf"""SELECT page_id, kind AS surface_kind, CASE WHEN kind = 'grid' THEN 'modal' ELSE 'in-place' END AS open_mode FROM (SELECT page_id, CASE WHEN p = '/' THEN 'home-feed' WHEN p LIKE '/explore%' THEN 'grid' WHEN p LIKE '/reels%' OR p LIKE '/reel/%' THEN 'reels'
WHEN regexp_matches(p, '^/[^/]+/saved(/|$)') THEN 'grid' WHEN len(s) BETWEEN 1 AND 2 AND s[1] NOT IN ({_RESERVED}) THEN 'grid' ELSE 'unknown' END AS kind
FROM (SELECT page_id, p, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM (SELECT page_id, {_PATH} AS p FROM pages)))"""
)
def surface_kind(t):
    return t("pages").select("page_id", tx.surface_kind(F.col("url")).alias("surface_kind"), tx.open_mode(F.col("url")).alias("open_mode"))


@query(r"""SELECT p_partkey, CASE WHEN x = '' THEN 'unnamed' ELSE x END AS path FROM (SELECT p_partkey, substr(regexp_replace(regexp_replace(regexp_replace('. ' || p_name || ' : ' || p_type || '?', '[/\\:*?"<>|]', '_', 'g'), '\s+', '_', 'g'), '^[.\s_]+|[.\s_]+$', '', 'g'), 1, 200) AS x FROM part)""")
def sanitize_path(t):
    return t("part").select("p_partkey", tx.sanitize_path(F.concat(F.lit(". "), F.col("p_name"), F.lit(" : "), F.col("p_type"), F.lit("?"))).alias("path"))


@query("SELECT doc_id, sha256(text) AS sha256, to_base64(encode(text)) AS base64, 'media/' || CASE WHEN lang = 'en' THEN 'images' WHEN lang = 'de' THEN 'videos' ELSE 'other' END || '/' || doc_id AS blob_path FROM documents")
def digests(t):
    kind = F.when(F.col("lang") == "en", "image").when(F.col("lang") == "de", "video")
    return t("documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.translate(F.base64(F.col("text").cast("binary")), "\r\n", "").alias("base64"), tx.blob_path(F.col("doc_id").cast("string"), kind).alias("blob_path"))


@query("SELECT o_custkey AS owner, list_aggregate(list_distinct(list_concat(list(o_orderkey ORDER BY o_orderkey), [0, min(o_orderkey)])), 'sum')::BIGINT AS total, len(list_distinct(list_concat(list(o_orderkey), [0, min(o_orderkey)])))::INT AS n, CASE WHEN min(o_orderkey) = 0 THEN 'single-image' ELSE 'carousel' END AS layout FROM orders GROUP BY 1")
def union_media(t):
    posts = t("orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.array_sort(F.collect_list(F.col("o_orderkey").cast("string"))).alias("media_uris"), F.min("o_orderkey").alias("least")).withColumn("layout", F.lit("single-image"))
    wide = normalize.widen(posts, F.array(F.lit("0"), F.col("least").cast("string")))
    return wide.select("owner", F.aggregate("media_uris", F.lit(0).cast("long"), lambda s, x: s + x.cast("long")).alias("total"), F.size("media_uris").alias("n"), "layout")


# --- notes and lines --------------------------------------------------------------------------------------------------------

_NOTE_PARTS = """SELECT o_orderkey AS k, o_orderkey::VARCHAR AS id, CASE WHEN o_orderkey % 3 <> 0 THEN 'https://example.com/o/' || o_orderkey END AS url, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, 'customer ' || o_custkey AS handle, o_orderpriority AS body,
list_transform(range(1, o_orderkey % 4 + 1), lambda i: {media}) AS media FROM orders"""
_FRONT = "'sourceUrl: ' || coalesce('\"' || url || '\"', 'null') || chr(10) || 'providerName: orders' || chr(10) || 'externalId: ' || id || chr(10) || 'extractedAt: \"' || iso || '\"' || chr(10) || 'author: {\"handle\":\"' || handle || '\"}' || chr(10) || '---'"
_SHOWN = "CASE WHEN len(media) > 0 THEN chr(10) || chr(10) || array_to_string(media, chr(10) || chr(10)) ELSE '' END || chr(10)"
_HERE = "(i % 2 = 1)"


def _items(t):
    rows = _resources(t)
    there = F.transform(F.filter("media", lambda m: F.substring_index(m["id"], "_", -1).cast("int") % 2 == 1), lambda m: m["id"])
    return rows.withColumn("present", there)


def _note_sql(head: str, media: str, of: str = "md5") -> str:
    return f"SELECT id, {of}('---' || chr(10) || {head} || {_FRONT} || chr(10) || chr(10) || body || {_SHOWN}) AS note FROM ({_NOTE_PARTS.format(media=media)})"


@query(_note_sql("''", f"'![image](' || CASE WHEN {_HERE} THEN 'media/' || o_orderkey || '_' || i ELSE 'https://example.com/' || o_orderkey || '/' || i END || ')'"))
def render_markdown(t):
    return export.markdown_parts(_items(t), "link-local").where("kind = 'text'").select("id", F.md5("text").alias("note"))


@query(_note_sql("'tags: [order, orders]' || chr(10) || 'kind: order' || chr(10)", f"CASE WHEN {_HERE} THEN '![[attachments/' || o_orderkey || '_' || i || ']]' ELSE '![image](https://example.com/' || o_orderkey || '/' || i || ')' END"))
def render_obsidian(t):
    return export.vault_parts(_items(t), "link-local").where("kind = 'text'").select("id", F.md5("text").alias("note"))


def _line_sql(where: str, local: str) -> str:
    media = "'{\"mediaId\":\"' || o_orderkey || '_' || i || '\",\"type\":\"image\",\"sourceUri\":\"https://example.com/' || o_orderkey || '/' || i || '\"' || " + local + " || '}'"
    front = "'{\"sourceUrl\":' || coalesce('\"' || url || '\"', 'null') || ',\"providerName\":\"orders\",\"externalId\":\"' || id || '\",\"extractedAt\":\"' || iso || '\",\"author\":{\"handle\":\"' || handle || '\"}}'"
    line = f"'{{\"resourceId\":\"' || id || '\",\"kind\":\"order\",\"frontmatter\":' || {front} || ',\"body\":[{{\"type\":\"text\",\"value\":\"' || body || '\"}}],\"media\":[' || array_to_string(media, ',') || ']}}'"
    return f"SELECT id, {line} AS line FROM ({_NOTE_PARTS.format(media=media)}) WHERE {where}"


@query(_line_sql("true", f"CASE WHEN {_HERE} THEN ',\"localPath\":\"media/' || o_orderkey || '_' || i || '\"' ELSE '' END"))
def json_lines(t):
    return export.json_lines(_items(t), "link-local")


@query(_line_sql(f"iso > '{WATERMARK}'", "''"))
def ndjson_export(t):
    """The flagship: resources above a watermark, without media, as lines."""
    rows = _resources(t).where(export.above_watermark(F.col("source.extracted_at"), WATERMARK))
    return export.json_lines(export.present_media(rows, _metadata(t), "none"), "none")


@query(f"""WITH {_LINKS} SELECT o_orderkey::VARCHAR AS id, count(there.media_id) AS n, count(*) FILTER (there.media_id IS NULL) AS absent FROM links LEFT JOIN there USING (media_id) GROUP BY 1""")
def export_presence(t):
    found = export.present_media(_resources(t), _metadata(t), "link-local").where(F.size("media") > 0)
    return found.select("id", F.size("present").cast("long").alias("n"), (F.size("media") - F.size("present")).cast("long").alias("absent"))


@query("SELECT conv_id, count(*) AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS thread FROM conversations GROUP BY conv_id")
def children_thread(t):
    rows = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("children"))
    return rows.select("conv_id", F.size("children").cast("long").alias("n"), F.md5(F.array_join(F.transform("children", lambda c: F.concat(c["role"], F.lit(":"), c["text"])), "\n")).alias("thread"))


@query()
def extract_pages(t):
    return extract.extract(t("pages")).select("page_id", "article", "strategy", "failure")


@query("SELECT page_id, 0 AS n FROM pages WHERE false")
def discover_pages(t):
    return extract.discover(t("pages")).groupBy("page_id").agg(F.count("*").cast("int").alias("n"))


# --- streams ----------------------------------------------------------------------------------------------------------------

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.read_stream(spark, sf_dir, EVENTS, names="events.parquet")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _event_stream(spark, sf_dir).select(F.concat_ws("|", "user_id", "event_type").alias("fingerprint"))
    return pipelines.run_available(pipelines.distinct_discoveries(keyed), "silt_stream_dedup")


def stream_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _event_stream(spark, sf_dir).where("event_type IN ('view', 'error')").select(F.col("user_id").cast("string").alias("target_uri"), F.when(F.col("event_type") == "view", "enqueue").otherwise("failed").alias("event"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    out = pipelines.run_available(pipelines.task_machine(events, timers=False), "silt_stream_tasks", mode="update")
    return out.select("target_uri", "state", "attempts", "next_retry_at")


QUERIES |= {"stream_dedup": stream_dedup, "stream_tasks": stream_tasks}
SQL |= {
    "stream_dedup": "SELECT DISTINCT user_id || '|' || event_type AS fingerprint FROM events",
    "stream_tasks": """WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type IN ('view', 'error')),
first AS (SELECT user_id, min(ms) AS since FROM e WHERE event_type = 'view' GROUP BY 1),
n AS (SELECT first.user_id, count(e.ms) AS tries, max(e.ms) AS ms FROM first LEFT JOIN e ON e.user_id = first.user_id AND e.event_type = 'error' AND e.ms > since GROUP BY 1)
SELECT user_id::VARCHAR AS target_uri, CASE WHEN tries < 3 THEN 'queued' ELSE 'failed' END AS state, tries::INT AS attempts, CASE WHEN tries BETWEEN 1 AND 2 THEN ms + 1000 * (2 ** (tries - 1))::BIGINT ELSE 0 END AS next_retry_at FROM n""",
}
