import random

import pytest
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.operators import dedup, enrich, metrics, retention, scheduler

NONE = "media_id string"


def resource(i, *media, state="hydrated", complete=True, children=None):
    m = [(x, "image", f"https://e.com/{x}", None, None, None) if isinstance(x, str) else x for x in media]
    return (i, "post", state, ("p", i, None, "2024-01-01T00:00:00.000Z", None), None, [], m, children, (True, True, complete, False))


def resources(spark, *rows):
    return spark.createDataFrame(list(rows), schema.RESOURCE)


def metadata(spark, *ids):
    return spark.createDataFrame([(i, "image", 1) for i in ids], "id string, type string, size_bytes long")


def test_reconciliation(spark):
    rows = resources(spark, resource("ready1", "m_ready"), resource("missing1", "m_missing"), resource("skipped1", "m", complete=False), resource("empty1"), resource("fail1", "m_ready"), resource("other", "m", state="extracted"))
    fails = lambda items: items.select("id", F.when(F.col("id") == "fail1", "boom").alias("error"), F.array().cast(schema.CONTENT).alias("blocks"))
    items, report = enrich.run_pass(rows, metadata(spark, "m_ready"), fails)
    assert {r["id"]: r["outcome"] for r in items.collect()} == {"ready1": "ready", "missing1": "missing", "skipped1": "skipped", "empty1": "ready", "fail1": "failed"}
    r = report.first()
    assert r["enumerated"] == r["ready"] + r["missing"] + r["skipped"] + r["failed"] == 5 and r["enriched"] == 2
    after = {x["id"]: (x["state"], x["completeness"]["ocr"]) for x in items.collect()}
    assert after["ready1"] == ("enriched", True) and after["missing1"] == ("hydrated", False)


def test_text_recognition(spark):
    rows = resources(spark, resource("a", "i1", "i2", "i3", "gone"))
    blobs = spark.createDataFrame([("i1", bytearray(b" hi ")), ("i2", bytearray(b"  ")), ("i3", bytearray(b"bad"))], "media_id string, content binary")

    def engine():
        def read(content):
            if content == b"bad":
                raise ValueError("unreadable")
            return content.decode()

        return read

    items, _ = enrich.run_pass(rows, metadata(spark, "i1", "i2", "i3", "gone"), enrich.ocr_handler(blobs, engine))
    r = items.first()
    assert (r["outcome"], [(b["type"], b["value"]) for b in r["content"]]) == ("ready", [("transcript", "hi")])
    missing, _ = enrich.run_pass(rows, metadata(spark, "i1"), enrich.ocr_handler(blobs, engine))
    assert missing.first()["state"] == "hydrated" and missing.first()["content"] == []


def test_capture(spark):
    video = ("v", "video", "https://e.com/v", None, None, None)
    child = ("kid", "slide", "extracted", ("p", "k", None, "t", None), None, [], [("slide_media_0", "image", "https://e.com/k", None, None, None)], (True, True, True, False))
    rows = resources(spark, resource("mixed", "i", video, state="extracted"), resource("none", state="extracted"), resource("good", "g", state="extracted", children=[child]), resource("big", "b", state="extracted"), resource("lost", "l", state="extracted"))

    def transport(uri):
        if uri.endswith("/l"):
            raise OSError("refused")
        return b"x" * (30 if uri.endswith("/b") else 3)

    got, log = enrich.hydrate(rows, enrich.fetch(enrich.capture_plan(rows), transport), max_bytes=20)
    state = {r["id"]: (r["state"], r["completeness"]["media"]) for r in got.collect()}
    assert state == {"mixed": ("extracted", False), "none": ("extracted", True), "good": ("hydrated", True), "big": ("extracted", False), "lost": ("extracted", False)}
    results = {r["media_id"]: (r["result"], r["error"]) for r in log.collect()}
    assert results["i"] == ("persisted", None) and results["v"] == ("skipped", None) and results["l"] == ("failed", "refused") and results["b"][1].startswith("Too large")
    kid = got.where("id = 'good'").first()["children"][0]
    assert (kid["state"], kid["media"][0]["local_uri"], kid["media"][0]["size_bytes"]) == ("hydrated", "media/slide_media_0", 3)


def media_table(spark, *rows):
    return spark.createDataFrame(list(rows), "media_id string, size_bytes long, last_access string, type string")


def owned(spark, *rows):
    return spark.createDataFrame(list(rows), "resource_id string, state string, media_id string")


def evict(spark, media, cap, owners=None, pins=(), **options):
    owners = owners or [(f"r_{m[0]}", "enriched", m[0]) for m in media]
    pinned = spark.createDataFrame([(p,) for p in pins], "resource_id string")
    rows, report = retention.plan(media_table(spark, *media), owned(spark, *owners), pinned, max_bytes=cap, **options)
    return sorted(r["media_id"] for r in rows.where("evicted").collect()), report.first()


def at(n):
    return f"2024-01-01T00:00:{n:02d}.000Z"


@pytest.mark.parametrize(("sizes", "cap", "gone"), [([100, 100, 100], 200, ["m0"]), ([100] * 4, 150, ["m0", "m1", "m2"]), ([300, 300], 400, ["m0"]), ([100, 100], 200, [])])
def test_least_recently_used_go_first(spark, sizes, cap, gone):
    evicted, report = evict(spark, [(f"m{i}", s, at(i), "image") for i, s in enumerate(sizes)], cap)
    assert evicted == gone and report["bytes_after"] == sum(sizes) - sum(sizes[: len(gone)]) and report["skipped_under_cap"] == (not gone)


def loop(media, owners, pins, cap, retain):
    """The pass as a loop, to compare with."""
    total = sum(m[1] for m in media)
    counts = dict.fromkeys(("inspected", "evicted", "freed", "retained_video", "not_enriched", "pinned"), 0)
    if total <= cap:
        return counts
    for m in sorted(media, key=lambda m: (m[2], m[0])):
        if counts["freed"] >= total - cap:
            break
        counts["inspected"] += 1
        if retain and m[3] == "video":
            counts["retained_video"] += 1
        elif m[0] not in owners:
            counts["not_enriched"] += 1
        elif owners[m[0]] in pins:
            counts["pinned"] += 1
        else:
            counts["evicted"] += 1
            counts["freed"] += m[1]
    return counts


@pytest.mark.parametrize("seed", range(6))
def test_eviction_equals_the_loop(spark, seed):
    r = random.Random(seed)
    media = [(f"m{i:02d}", r.choice([0, 5, 10, 50]), at(r.randrange(6)), r.choice(["image", "video"])) for i in range(12)]
    owners = {m[0]: f"r{i}" for i, m in enumerate(media) if r.random() < 0.8}
    pins = {x for x in owners.values() if r.random() < 0.2}
    cap = r.randrange(0, 200)
    _, report = evict(spark, media, cap, [(o, "enriched", m) for m, o in owners.items()], pins, retain_video=True, buckets=3)
    wanted = loop(media, owners, pins, cap, True)
    assert {k: report[v] for k, v in {"inspected": "media_inspected", "evicted": "media_evicted", "freed": "bytes_freed", "retained_video": "skipped_retained_video", "not_enriched": "skipped_not_enriched", "pinned": "skipped_pinned"}.items()} == wanted


def test_keep_policy_and_failed_deletions(spark):
    media = [("a", 100, at(0), "image"), ("b", 100, at(1), "image")]
    assert evict(spark, media, 0, policy="keep")[0] == []
    failed = spark.createDataFrame([("a",)], NONE)
    gone, report = evict(spark, media, 100, failed=failed)
    assert gone == ["b"] and report["media_evicted"] == 1 and report["bytes_freed"] == 100


def tasks(spark, *uris):
    return scheduler.new_tasks(spark.createDataFrame(list(enumerate(uris)), "seq long, target_uri string"))


def event(spark, uri, kind, at=0, error=None):
    return spark.createDataFrame([(uri, kind, at, error)], "target_uri string, event string, at long, error string")


def test_retries_and_permanent_failure(spark):
    t = tasks(spark, "u", "w")
    seen = []
    for _ in range(3):
        t = scheduler.apply(t, event(spark, "u", "failed", 1000, "e"))
        r = t.where("target_uri = 'u'").first()
        seen.append((r["state"], r["attempts"], r["next_retry_at"]))
    assert seen == [("queued", 1, 2000), ("queued", 2, 3000), ("failed", 3, None)]
    w = scheduler.apply(t, event(spark, "w", "failed_permanently", 5, "x")).where("target_uri = 'w'").first()
    assert (w["state"], w["attempts"], w["next_retry_at"], w["last_error"]) == ("failed", 3, None, "x")
    assert scheduler.apply(t, event(spark, "nobody", "completed")).count() == 2


def test_choice_recovery_and_depth(spark):
    t = tasks(spark, "a", "b", "c").withColumn("priority", F.when(F.col("target_uri") == "a", 0).otherwise(5))
    assert scheduler.next_task(t, 0).first()["target_uri"] == "b"
    later = t.withColumn("next_retry_at", F.lit(100).cast("long"))
    assert scheduler.next_task(later, 99).count() == 0 and scheduler.next_task(later, 100).count() == 1
    busy = scheduler.apply(t, event(spark, "a", "opening"))
    once = scheduler.restore(busy)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, scheduler.restore(once).collect())) and scheduler.depth(once).first().asDict() == {"queue_depth": 3, "drained": False}
    assert scheduler.depth(t.limit(0)).first()["drained"] is True


def test_enqueue_counts_duplicates(spark):
    known = tasks(spark, "a")
    batch = spark.createDataFrame([(0, "a"), (1, "b"), (2, "b"), (3, "c")], "seq long, target_uri string")
    new, count = dedup.enqueue(known, batch)
    assert sorted((r["seq"], r["target_uri"]) for r in new.collect()) == [(1, "b"), (3, "c")] and count.first()["duplicates"] == 2


def test_reports(spark):
    events = spark.createDataFrame([("s", i, c, "x" * 3000, "", "st") for i, c in enumerate(("navigation", "unknown"))], "session_id string, seq long, category string, dom_snapshot string, resource_uri string, strategy string").withColumn("root_cause", F.lit("r"))
    failed = metrics.failures(events, by=["session_id"], order=["seq"])
    record = failed.first()["failures"]
    assert [f["category"] for f in record] == ["navigation", "unknown"] and len(record[0]["dom_snapshot"]) == 2000 and record[0]["resource_uri"] is None
    report = metrics.session_report(spark.createDataFrame([("s", 1)], "session_id string, discovered long"), failed, events).first()
    assert report["strategy_usage"] == {"st": 2} and report["metrics"]["discovered"] == 1
    permanent = spark.createDataFrame([("navigation", "Not Found"), ("extraction", "No article element here"), ("extraction", "not found")], "stage string, m string")
    assert [r[0] for r in permanent.select(scheduler.is_permanent(F.col("stage"), F.col("m"))).collect()] == [True, True, False]


def test_tasks_that_gather_failures_grow_with_their_number(spark, monkeypatch):
    monkeypatch.setattr(metrics, "GATHERED", 100)
    c = lambda x: F.lit(x)
    events = spark.range(1200).select((F.col("id") % 300).alias("s"), F.col("id").alias("n"), c("k").alias("category"), c("r").alias("root_cause"), F.repeat(c("x"), 2100).alias("dom_snapshot"), c("").alias("resource_uri"), c("t").alias("strategy"))
    found = metrics.failures(events, by=["s"], order=["n"])
    assert found.rdd.getNumPartitions() == 12
    rows = found.select("s", F.size("failures").alias("n"), F.length(F.col("failures")[0]["dom_snapshot"]).alias("cut")).collect()
    assert len(rows) == 300 and {(r["n"], r["cut"]) for r in rows} == {(4, 2000)}
