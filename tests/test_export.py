import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.plans import export, gateways
from siltworks.sources.store import Store


def row(i, at="2024-01-15T10:00:00.000Z", media=(), children=None, uri="https://e.com/p", author=("a", "@testuser", "Test User", None, None), metadata=None):
    content = [("text", "Hello world", None), ("heading", "Section A", None)]
    return (i, "post", "enriched", ("prov", f"ext_{i}", uri, at, metadata), author, content, [(m, "image", f"https://e.com/{m}", None, None, None) for m in media], children, (True, True, True, True))


def child(i):
    return (i, "post", "enriched", ("prov", i, None, "t", None), None, [], [], (True, True, True, True))


def resources(spark, *rows):
    return spark.createDataFrame(list(rows), schema.RESOURCE)


def items(spark, *rows, there=(), inclusion="link-local"):
    return export.present_media(resources(spark, *rows), spark.createDataFrame([(x,) for x in there], "id string"), inclusion)


def texts(parts):
    return {r["path"]: r["text"] for r in parts.where("kind = 'text'").collect()}


def test_markdown_note(spark):
    parts = export.markdown_parts(items(spark, row("r/1", media=("m1", "m2")), there=("m1",)), "link-local")
    assert texts(parts) == {
        "r/1.md": '---\nsourceUrl: "https://e.com/p"\nproviderName: prov\nexternalId: ext_r/1\nextractedAt: "2024-01-15T10:00:00.000Z"\nauthor: {"handle":"@testuser","displayName":"Test User"}\n---\n\nHello world\n\n## Section A\n\n![image](media/m1)\n\n![image](https://e.com/m2)\n'
    }
    assert [(r["path"], r["media_id"]) for r in parts.where("kind = 'binary'").collect()] == [("media/m1", "m1")]


def test_absent_values_in_notes(spark):
    r = list(row("a", uri=None, author=None))
    r[5] = []
    assert texts(export.markdown_parts(items(spark, tuple(r)), "none")) == {"a.md": '---\nsourceUrl: null\nproviderName: prov\nexternalId: ext_a\nextractedAt: "2024-01-15T10:00:00.000Z"\n---\n'}


def test_vault_note_with_children(spark):
    found = export.vault_parts(items(spark, row("a:b", media=("m/1",), children=[child("child/weird:id")]), there=("m/1",)), "link-local")
    note = texts(found)["post/a_b.md"]
    assert note.startswith("---\ntags: [post, prov]\nkind: post\nsourceUrl: ") and "![[attachments/m_1]]" in note and note.endswith("## Children\n\n- [[post/child_weird_id]]\n")
    assert "post/child_weird_id.md" in texts(found)
    assert [r["path"] for r in found.where("kind = 'binary'").collect()] == ["attachments/m_1"]


def test_json_lines_keep_key_order_and_absence(spark):
    lines = {r["id"]: r["line"] for r in export.json_lines(items(spark, row("a", media=("m",), children=[]), row("b", uri=None, author=None, metadata='{"layout":"reel"}'), there=("m",)), "link-local").collect()}
    a, b = json.loads(lines["a"]), json.loads(lines["b"])
    assert list(a) == ["resourceId", "kind", "frontmatter", "body", "media", "children"] and a["children"] == [] and a["media"][0]["localPath"] == "media/m"
    assert list(b) == ["resourceId", "kind", "frontmatter", "body", "media"] and b["frontmatter"] == {"sourceUrl": None, "providerName": "prov", "externalId": "ext_b", "extractedAt": "2024-01-15T10:00:00.000Z", "sourceMetadata": {"layout": "reel"}}


def test_no_join_is_planned_without_media(spark):
    plan = items(spark, row("a", media=("m",)), there=("m",), inclusion="none")._jdf.queryExecution().toString()
    assert "Join" not in plan
    with pytest.raises(ValueError):
        items(spark, row("a"), inclusion="other")


def test_archive(spark, tmp_path):
    found = export.entries(export.markdown_parts(items(spark, row("b", media=("m",)), row("a"), there=("m",)), "link-local"), spark.createDataFrame([("m", bytearray(b"xyz"))], "media_id string, content binary"))
    assert export.write_zip(found, str(tmp_path / "x.zip")) == 3
    with zipfile.ZipFile(tmp_path / "x.zip") as z:
        assert z.namelist() == ["a.md", "b.md", "media/m"] and z.read("media/m") == b"xyz" and {i.compress_type for i in z.infolist()} == {0} and z.infolist()[0].date_time[0] == 1980
    assert export.zip_bytes({"b": b"1", "a": b"2"}) == export.zip_bytes({"a": b"2", "b": b"1"}) and export.crc32(b"123456789") == 0xCBF43926
    url = spark.range(1).select(export.data_url(F.lit("hi").cast("binary"), F.lit("text/plain"))).first()[0]
    assert url == "data:text/plain;base64,aGk="


@pytest.fixture
def coordinator(spark, tmp_path):
    return export.Coordinator(Store(spark, str(tmp_path / "store")))


def run(coordinator, spark, path, **options):
    blobs = spark.createDataFrame([], "media_id string, content binary")
    return coordinator.run(**({"request_id": "r1", "target": "json", "path": str(path), "blobs": blobs, "now": "2024-08-01T00:00:00.000Z", "incremental": True} | options))


def test_incremental_runs(spark, coordinator, tmp_path):
    store = coordinator.store
    store.save("export_manifest", spark.createDataFrame([("json", "2024-06-01T00:00:00.000Z", "r0", 10, 2, "c", "u")], schema.MANIFEST))
    store.save("resources", resources(spark, row("old1", "2024-01-01T00:00:00.000Z"), row("exact", "2024-06-01T00:00:00.000Z"), row("new1", "2024-06-01T00:00:00.001Z"), row("new2", "2024-07-15T12:00:00.000Z")))
    result = run(coordinator, spark, tmp_path / "1.ndjson")
    assert (result.exported, result.skipped) == (2, 2)
    assert [json.loads(x)["resourceId"] for x in (tmp_path / "1.ndjson").read_text().splitlines()] == ["new1", "new2"]
    m = coordinator.manifest("json")
    assert (m["resources_exported_total"], m["export_count"], m["created_at"], m["last_exported_at"]) == (12, 3, "c", "2024-08-01T00:00:00.000Z")
    again = run(coordinator, spark, tmp_path / "2.ndjson", request_id="r2")
    assert (again.exported, again.skipped, (tmp_path / "2.ndjson").read_bytes()) == (0, 4, b"")


def test_cancelled_run_delivers_nothing(spark, coordinator, tmp_path):
    coordinator.store.save("resources", resources(spark, row("a")))
    coordinator.store.put_state("export_cancelled:r1", "1")
    with pytest.raises(export.Cancelled):
        run(coordinator, spark, tmp_path / "x.ndjson")
    assert not (tmp_path / "x.ndjson").exists() and coordinator.manifest("json") is None and coordinator.progress() is None
    assert coordinator.resume(str(tmp_path / "y"), None, "t") is None


def test_archive_run_counts_media(spark, coordinator, tmp_path):
    coordinator.store.save("resources", resources(spark, row("a", media=("m", "lost"))))
    facts = spark.createDataFrame([(i, "image", "m", 1, "h", "p", "complete", "t", "t", None) for i in ("m", "lost")], schema.MEDIA_METADATA)
    coordinator.store.save("media_metadata", facts)
    blobs = spark.createDataFrame([("m", bytearray(b"1"))], "media_id string, content binary")
    result = run(coordinator, spark, tmp_path / "x.zip", target="obsidian", blobs=blobs, incremental=False)
    assert (result.media_included, result.media_missing, coordinator.manifest("obsidian")) == (1, 1, None)


def test_folder_gateway(spark, tmp_path):
    coordinator = export.Coordinator(Store(spark, str(tmp_path / "store")), gateways.Folder(spark))
    coordinator.store.save("resources", resources(spark, row("b", media=("m", "lost")), row("../a"), row("c/d")))
    coordinator.store.save("media_metadata", spark.createDataFrame([(i, "image", "m", 1, "h", "p", "complete", "t", "t", None) for i in ("m", "lost")], schema.MEDIA_METADATA))
    blobs = spark.createDataFrame([("m", bytearray(b"xyz"))], "media_id string, content binary")
    at = tmp_path / "out"
    for _ in range(2):  # a second delivery takes the place of the first
        result = run(coordinator, spark, at, request_id=None, target="markdown", blobs=blobs, incremental=False)
    found = {str(p.relative_to(at)): p.read_bytes() for p in at.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert set(found) == {"b.md", "%2E%2E/a.md", "c/d.md", "media/m"} and found["media/m"] == b"xyz" and b"![image](media/m)" in found["b.md"]
    assert result.size_bytes == sum(map(len, found.values())) and (result.media_included, result.media_missing) == (1, 1)
    lines = run(coordinator, spark, tmp_path / "lines", request_id="r2")
    read = [r["value"] for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert sorted(json.loads(x)["resourceId"] for x in read) == ["../a", "b", "c/d"] and lines.size_bytes == sum(len(x.encode()) + 1 for x in read)
    assert not list(tmp_path.glob("*.partial"))


def test_a_gateway_that_fails_leaves_nothing(spark, coordinator, tmp_path):
    class Broken(export.OneFile):
        def lines(self, rows, path):
            raise OSError("no room")

    coordinator.store.save("resources", resources(spark, row("a")))
    good, coordinator.gateway = coordinator.gateway, Broken(spark)
    with pytest.raises(OSError):
        run(coordinator, spark, tmp_path / "x")
    assert coordinator.manifest("json") is None and not coordinator.progress()["done"]
    coordinator.gateway = good
    result = coordinator.resume(str(tmp_path / "x"), spark.createDataFrame([], "media_id string, content binary"), "t")
    assert result.exported == 1 and coordinator.manifest("json")["resources_exported_total"] == 1


def test_names_of_artifacts(spark, coordinator):
    assert coordinator.path_in("/d/", "json", "2024-08-01T01:02:03.004Z") == "/d/knowledge-export-json-2024-08-01T01-02-03-004Z.ndjson"
    assert coordinator.path_in("/d", "obsidian", "2024-08-01T01:02:03.004Z").endswith("-obsidian-2024-08-01T01-02-03-004Z.zip")
    assert gateways.inner_path("a/../b//./c..d") == "a/%2E%2E/b/%25/%2E/c..d"


def test_ids_of_media_are_joined_by_exchange(spark):
    plan = items(spark, row("a", media=("m",)), there=("m",))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pages_of_a_run_read_staged_items_in_order(spark, coordinator, tmp_path, monkeypatch):
    coordinator.store.save("resources", resources(spark, *[row(f"{i:03d}", media=("m",)) for i in range(60)]))
    pages = []
    monkeypatch.setattr(export, "json_lines", lambda rows, inclusion, of=export.json_lines: pages.append(rows) or of(rows, inclusion))
    monkeypatch.setattr(export, "present_media", lambda *x, of=export.present_media, calls=pages.append: calls("joined") or of(*x))
    result = run(coordinator, spark, tmp_path / "x", incremental=False, page_rows=10)
    assert result.exported == 60 and pages[0] == "joined" and pages.count("joined") == 1 and len(pages) == 7
    assert [json.loads(x)["resourceId"] for x in (tmp_path / "x").read_text().splitlines()] == [f"{i:03d}" for i in range(60)]
    assert not list((tmp_path / "store" / "_exports").glob("*"))


def test_staged_items_are_gone_when_the_artifact_is_put_together(spark, coordinator, tmp_path):
    left = []

    class Looking(export.OneFile):
        def archive(self, entry_rows, path):
            left.extend(p.name for p in (tmp_path / "store" / "_exports").glob("*/*"))
            return super().archive(entry_rows, path)

    coordinator.gateway = Looking(spark)
    coordinator.store.save("resources", resources(spark, row("a"), row("b")))
    result = run(coordinator, spark, tmp_path / "x.zip", target="markdown", incremental=False)
    assert (result.exported, left) == (2, ["parts"])


def test_media_are_counted_before_the_artifact_lies_beside_the_exchanged_rows(spark, coordinator, tmp_path, monkeypatch):
    order = []

    class Looking(export.OneFile):
        def archive(self, entry_rows, path):
            order.append("archive")
            return super().archive(entry_rows, path)

    coordinator.gateway = Looking(spark)
    coordinator.store.save("resources", resources(spark, row("a", media=("m",))))
    coordinator.store.save("media_metadata", spark.createDataFrame([("m", "image", "m", 1, "h", "p", "complete", "t", "t", None)], schema.MEDIA_METADATA))
    blobs = spark.createDataFrame([("m", bytearray(b"1"))], "media_id string, content binary")
    monkeypatch.setattr(F, "count_if", lambda c, of=F.count_if: order.append("count") or of(c))
    result = run(coordinator, spark, tmp_path / "x.zip", target="obsidian", blobs=blobs, incremental=False)
    assert (result.media_included, result.media_missing, order) == (1, 0, [*["count"] * 4, "archive"])
