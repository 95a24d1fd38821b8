import pytest
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.sources import media
from siltworks.sources.memory import MemoryStore
from siltworks.sources.store import Conflict, NewerSchema, Store, delete, page, query_page, upsert

TASK = schema.TASK


def ids(df):
    return [r["id"] for r in df.orderBy("id").collect()]


def table(spark, *keys, state="s"):
    return spark.createDataFrame([(k, state) for k in keys], "id string, state string")


def pages(df, size, **options):
    found, cursor = [], None
    while True:
        got = query_page(df, size, cursor=cursor, **options).orderBy("id").collect()
        found.append([r["id"] for r in got])
        if not got or not got[0]["has_more"]:
            return found
        cursor = got[0]["next_cursor"]


def test_pages_follow_each_other(spark):
    assert pages(table(spark, *"abcde"), 3) == [["a", "b", "c"], ["d", "e"]]
    assert pages(table(spark, "z9", "a1", "m5", "b2", "k3", "f8"), 2) == [["a1", "b2"], ["f8", "k3"], ["m5", "z9"]]
    assert pages(table(spark, *"abc"), 1) == [["a"], ["b"], ["c"]]


def test_a_cursor_row_may_be_gone_and_a_cursor_may_lie_behind_all(spark):
    df = table(spark, "c1", "c3", "c4")
    assert [r["id"] for r in page(df, 2, after="c2").collect()] == ["c3", "c4"]
    assert page(df, 2, after="￿").count() == 0
    assert page(df.limit(0), 2).count() == 0


def test_state_filter(spark):
    df = table(spark, "a", "b").unionByName(table(spark, "c", state="t"))
    assert pages(df, 5, state="t") == [["c"]]


def test_upsert_and_delete_are_idempotent(spark):
    old = table(spark, "a", "b")
    new = table(spark, "b", "c", state="new")
    once = upsert(old, new, "id")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert(once, new, "id").collect())) == [("a", "s"), ("b", "new"), ("c", "new")]
    assert ids(delete(old, table(spark, "b", "x"), "id")) == ["a"]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def task(spark, uri, state="queued", seq=0):
    return spark.createDataFrame([(uri, uri, state, 0, 0, 3, None, None, seq)], TASK)


def test_snapshots(spark, store):
    assert store.read("tasks").count() == 0
    store.save("tasks", task(spark, "a"))
    store.save("tasks", task(spark, "b").unionByName(task(spark, "a", "completed")))
    assert {r["id"]: r["state"] for r in store.read("tasks").collect()} == {"a": "completed", "b": "queued"}
    assert store.read("tasks", 1).count() == 1
    assert store.get("tasks", "b").first()["state"] == "queued"
    store.remove("tasks", spark.createDataFrame([("a",), ("nobody",)], "target_uri string"))
    assert store.count("tasks") == 1


def test_transaction_keeps_the_last_operation_and_ends(spark, store):
    store.save("tasks", task(spark, "a"))
    t = store.transaction()
    t.put("tasks", task(spark, "b"))
    t.delete("tasks", spark.createDataFrame([("a",), ("b",)], "target_uri string"))
    t.put("tasks", task(spark, "b", "failed"))
    t.commit()
    assert [(r["id"], r["state"]) for r in store.read("tasks").collect()] == [("b", "failed")]
    with pytest.raises(RuntimeError):
        t.put("tasks", task(spark, "c"))
    t = store.transaction()
    t.put("tasks", task(spark, "z"))
    t.rollback()
    assert store.count("tasks") == 1


def test_one_row_a_key(spark):
    new = table(spark, "a", "a").unionByName(table(spark, "a", "b", state="t"))
    assert ids(upsert(table(spark, "a"), new, "id")) == ["a", "b"]
    assert upsert(table(spark, "a"), new, "id").collect() == upsert(table(spark, "a"), new, "id").collect()


def test_a_second_writer_fails_and_nothing_is_lost(spark, store):
    store.save("tasks", task(spark, "a"))
    base = store.latest_number()
    mine = upsert(store.read("tasks", base), task(spark, "x"), "target_uri")
    Store(spark, store.root).save("tasks", task(spark, "z"))
    with pytest.raises(Conflict):
        store.commit("tasks", mine, base=base)
    assert sorted(r["id"] for r in store.read("tasks").collect()) == ["a", "z"]
    store.commit("control_state", spark.createDataFrame([("k", "v")], schema.CONTROL_STATE), base=base)  # another table: no conflict
    assert store.get_state("k") == "v" and store.count("tasks") == 2


def test_tables_change_together_or_not_at_all(spark, store):
    store.put_state("k", "1")
    t = store.transaction()
    t.put("tasks", task(spark, "a"))
    t.put("control_state", spark.createDataFrame([("k", "2")], schema.CONTROL_STATE))
    store.put_state("k", "9")
    with pytest.raises(Conflict):
        t.commit()
    assert store.count("tasks") == 0 and store.get_state("k") == "9"
    t = store.transaction()
    t.put("tasks", task(spark, "a"))
    t.put("control_state", spark.createDataFrame([("k", "3")], schema.CONTROL_STATE))
    t.commit()
    assert store.version("tasks") == store.version("control_state") and store.get_state("k") == "3"


def test_records_without_an_end(spark, store):
    store.put_state("k", "1")
    store._fs.create(store._path(f"{store.root}/_commits/000000002"), False).close()
    assert store.get_state("k") == "1"
    with pytest.raises(Conflict):
        store.put_state("k", "2")
    assert store.clear_unfinished() == 1 and store.put_state("k", "2") == 2


def test_control_state_sessions_and_migration(spark, store):
    assert store.get_state("k") is None
    store.put_state("k", "1")
    store.put_state("k", "2")
    assert store.get_state("k") == "2"
    store.delete_state("k")
    assert store.get_state("k") is None
    assert store.migrate() == schema.SCHEMA_VERSION == store.migrate()
    legacy = spark.createDataFrame([("old", "x"), ("none", None), ("schema_version", "0"), ("old", "a"), (None, "y")], schema.CONTROL_STATE)
    for _ in range(2):
        assert sorted(r["key"] for r in store.move_legacy_state(legacy).collect()) == ["none", "old", "schema_version"]
    assert store.get_state("old") == "x" and store.get_state("none") is None and store.get_state("schema_version") == str(schema.SCHEMA_VERSION)
    at = store.latest_number()
    assert store.move_legacy_state(legacy.limit(0)).count() == 0 and store.latest_number() == at
    store.start_session(spark.createDataFrame([("s1", "running", "t0", "t0", 0, "{}")], schema.SESSION))
    assert "s1" in store.get_state("current_session") and store.count("sessions") == 1


OLD = {**schema.TABLES, "tasks": "target_uri STRING, rank STRING, state STRING"}
NEW = {**schema.TABLES, "tasks": "target_uri STRING, priority INT, host STRING, state STRING"}
STEPS = {
    **schema.MIGRATIONS,
    3: schema.Step("numbers for ranks", {"tasks": {"priority": "cast(rank AS INT)", "rank": None}}),
    4: schema.Step("hosts, higher is sooner", {"tasks": {"priority": "-priority", "host": "concat(parse_url(target_uri, 'HOST'), ':', priority)"}}),
}


def steps(upto):
    return {n: s for n, s in STEPS.items() if n <= upto}


def test_migrations_change_rows_in_order_and_once(spark, tmp_path):
    root = str(tmp_path)
    old = Store(spark, root, tables=OLD)
    old.migrate()
    old.commit("tasks", spark.createDataFrame([("https://a/1", "7", "queued"), ("https://b/2", None, "failed")], OLD["tasks"]))
    old.commit("events", spark.range(2))
    new = Store(spark, root, tables=NEW, steps=STEPS)
    wanted = [("https://a/1", -7, "a:7", "queued"), ("https://b/2", None, None, "failed")]
    rows = lambda: [tuple(r) for r in new.read("tasks").orderBy("target_uri").collect()]
    assert rows() == wanted and new.get_state("schema_version") == "2"  # two versions behind: brought up by the reading query
    before = new.latest_number()
    assert new.migrate() == 4 and rows() == wanted and new.get_state("schema_version") == "4"
    assert new.latest_number() == before + 1 and new.migrate() == 4 and new.latest_number() == before + 1
    assert new.read("events").count() == 2 and new.version("events") < new.version("tasks")
    assert [r["target_uri"] for r in new.read("tasks", before).where("priority = -7").collect()] == ["https://a/1"]  # an old snapshot stays readable
    with pytest.raises(NewerSchema):
        old.read("tasks")


def test_upsert_and_transaction_on_an_older_snapshot(spark, tmp_path):
    Store(spark, str(tmp_path), tables=OLD).commit("tasks", spark.createDataFrame([("https://a/1", "7", "queued"), ("https://b/2", "1", "failed")], OLD["tasks"]))
    new = Store(spark, str(tmp_path), tables=NEW, steps=STEPS)
    new.save("tasks", spark.createDataFrame([("https://b/2", 9, "b", "queued")], NEW["tasks"]))
    change = new.transaction()
    change.delete("tasks", spark.createDataFrame([("https://a/1",)], "target_uri STRING"))
    change.commit()
    assert [tuple(r) for r in new.read("tasks").collect()] == [("https://b/2", 9, "b", "queued")]


def test_a_migration_loses_against_another_writer(spark, tmp_path, monkeypatch):
    old = Store(spark, str(tmp_path), tables=OLD)
    old.commit("tasks", spark.createDataFrame([("https://a/1", "7", "queued")], OLD["tasks"]))
    middle, new = Store(spark, str(tmp_path), tables={**NEW, "tasks": "target_uri STRING, priority INT, state STRING"}, steps=steps(3)), Store(spark, str(tmp_path), tables=NEW, steps=STEPS)
    at = new.latest_number()
    middle.migrate()
    monkeypatch.setattr(new, "latest_number", lambda: at)
    with pytest.raises(Conflict):
        new.migrate()
    monkeypatch.undo()
    assert new.migrate() == 4 and new.read("tasks").first()["priority"] == -7


def blobs(spark, *rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")


def put(spark, existing, now, *rows):
    new = spark.createDataFrame([(i, k, "m", bytearray(c), None) for i, k, c in rows], "id string, type string, mime_type string, content binary, source string")
    return media.put(new, existing, now)


def test_media_put_statistics_and_integrity(spark):
    none = spark.createDataFrame([], schema.MEDIA_METADATA)
    first = put(spark, none, "t1", ("i1", "image", b"ab"), ("i2", "image", b"abc"), ("v", "video", b"abcd"))
    stats = {r["kind"]: (r["media_count"], r["total_bytes"]) for r in media.statistics(first).collect()}
    assert stats == {None: (3, 9), "image": (2, 5), "video": (1, 4)}
    again = put(spark, first, "t2", ("i1", "image", b"xyz")).first()
    assert (again["created_at"], again["last_access"], again["size_bytes"], again["storage_path"]) == ("t1", "t2", 3, "media/images/i1")
    ok = {r["id"]: r["ok"] for r in media.verify(first, blobs(spark, ("media/images/i1", b"ab"), ("media/images/i2", b"zzz"), ("media/videos/w", b"abcd"))).collect()}
    assert ok == {"i1": True, "i2": False, "v": False}


def test_media_cleanup(spark):
    facts = put(spark, spark.createDataFrame([], schema.MEDIA_METADATA), "t", ("a", "image", b"x"), ("gone", "image", b"y"))
    stored = blobs(spark, ("media/images/a", b"x"), ("media/images/stray", b"s"), ("media/tmp/t", b""), ("media/meta/a.json", b"{}"))
    assert media.cleanup_report(facts, stored).first().asDict() == {"orphan_metadata_removed": 1, "orphan_blobs_removed": 1, "tmp_removed": 1}


def test_sidecars_skip_what_cannot_be_read(spark):
    texts = spark.createDataFrame([('{"id":"a","state":"complete"}',), ('{"id":"b","state":"writing"}',), ("{broken",), (None,)], "value string")
    assert ids(media.read_sidecars(texts)) == ["a"]
    facts = spark.createDataFrame([("a", "t1"), ("b", "t5")], "id string, last_access string")
    seen = media.with_last_access(facts, spark.createDataFrame([("a", "t3"), ("b", "t2")], "id string, at string"))
    assert {r["id"]: r["last_access"] for r in seen.collect()} == {"a": "t3", "b": "t5"}


def test_read_blobs(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"12345")
    assert media.read_blobs(spark, str(tmp_path)).select(F.col("length")).first()[0] == 5


def test_passes_do_not_overlap(store):
    with store.exclusive("janitor") as first, store.exclusive("janitor") as second, store.exclusive("other") as other:
        assert (first, second, other) == (True, False, True)
    with store.exclusive("janitor") as again:
        assert again
    store._fs.createNewFile(store._path(f"{store.root}/_passes/crashed"))
    with store.exclusive("crashed") as early, store.exclusive("crashed", lease_seconds=-1) as late:
        assert (early, late) == (False, True)


def test_memory_store_keeps_what_is_written_at_once(spark):
    store = MemoryStore(spark)
    task = lambda *keys: spark.createDataFrame([(k, k, "queued", 1, 0, 3, None, None, n) for n, k in enumerate(keys)], schema.TASK)
    assert store.count("tasks") == 0 and store.read("tasks").schema == schema.struct(schema.TASK)
    store.save("tasks", task("a", "b"))
    change = store.transaction()
    change.put("tasks", task("c").withColumn("state", F.lit("failed")))
    change.delete("tasks", spark.createDataFrame([("a",), ("nobody",)], "target_uri string"))
    change.rollback()
    assert {(r["target_uri"], r["state"]) for r in store.read("tasks").collect()} == {("b", "queued"), ("c", "failed")}
    store.save("tasks", task("a", "a"))
    change.commit()
    assert store.count("tasks") == 3 and store.get("tasks", "a").count() == 1 and store.get("tasks", "x").count() == 0
    assert store.query(5).count() == 0
    with pytest.raises(KeyError):
        store.save("nothing", task("a"))
