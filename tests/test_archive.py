"""Archives and joined files written by tasks, read by Python's zipfile and by the reader."""

import gc
import io
import time
import zipfile
import zlib

from pyspark.sql import functions as F

from siltworks.sources import archive


def test_an_archive_of_many_parts(spark, tmp_path):
    rows = [(f"d{i % 7}/ü{i}", bytes([i % 256]) * (i * 37)) for i in range(200)] + [("empty", None), (None, b"left out")]
    target = str(tmp_path / "a.zip")
    written = archive.write_archive(spark.createDataFrame(rows, "path string, content binary").repartition(5), target)
    wanted = sorted(((p, c or b"") for p, c in rows if p is not None), key=lambda x: x[0].encode())
    with zipfile.ZipFile(target) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == wanted
        assert {i.date_time for i in z.infolist()} == {(1980, 1, 1, 0, 0, 0)} and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}
    assert written == (len(wanted), (tmp_path / "a.zip").stat().st_size)
    got = archive.read_archive(spark, target).orderBy("place").collect()
    assert [(r["place"], r["path"], bytes(r["content"]), r["crc32"]) for r in got] == [(i, p, c, zlib.crc32(c)) for i, (p, c) in enumerate(wanted)]
    assert [x.name for x in tmp_path.iterdir() if not x.name.endswith(".crc")] == ["a.zip"]


def test_rows_of_a_path_are_appended_in_order(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("path"), (3000 - F.col("id")).alias("at"), F.concat(F.col("id").cast("string"), F.lit(",")).cast("binary").alias("content"))
    archive.write_archive(rows.repartition(6), str(tmp_path / "b.zip"), order=("at",))
    with zipfile.ZipFile(tmp_path / "b.zip") as z:
        wanted = {name: "".join(f"{i}," for i in reversed(range(3000)) if (i % 3 == 0) == (name == "a")).encode() for name in "ab"}
        assert {n: z.read(n) for n in z.namelist()} == wanted


def test_wide_fields(spark, tmp_path):
    rows = spark.range(70_000).select(F.format_string("%05d", "id").alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    archive.write_archive(rows, str(tmp_path / "many.zip"), limit=1000)
    with zipfile.ZipFile(tmp_path / "many.zip") as z:
        assert len(z.namelist()) == 70_000 and z.read("69999") == b"69999" and z.read("00000") == b"0"
    found = archive.read_archive(spark, str(tmp_path / "many.zip"))
    assert found.count() == 70_000 and found.where("cast(path AS INT) <> cast(cast(content AS STRING) AS INT) OR crc32(content) <> crc32").count() == 0
    with io.BytesIO(archive.local_header(b"n", 1, 5 << 30)) as head:
        assert len(head.read()) == 30 + 1 + 20


def test_empty_tables(spark, tmp_path):
    nothing = spark.createDataFrame([], "path string, content binary")
    assert archive.write_archive(nothing, str(tmp_path / "c.zip")).entries == 0
    assert zipfile.ZipFile(tmp_path / "c.zip").namelist() == [] and archive.read_archive(spark, str(tmp_path / "c.zip")).count() == 0
    assert archive.write_file(nothing.withColumn("id", F.lit(1)), str(tmp_path / "d"), order="id") == (0, 0)


def test_a_file_in_numeric_order_replaces_the_old_one(spark, tmp_path):
    (tmp_path / "e").write_text("old")
    rows = spark.range(500).select("id", F.concat(F.col("id").cast("string"), F.lit("\n")).cast("binary").alias("content")).repartition(7)
    archive.write_file(rows, str(tmp_path / "e"), order="id")
    assert (tmp_path / "e").read_text() == "".join(f"{i}\n" for i in range(500))


def test_a_lost_attempt_leaves_nothing(tmp_path):
    writer = archive.PartsWriter(str(tmp_path / "parts"), True, archive.LIMIT)
    rows = [("a", b"1"), ("b", b"2")]
    writer.write(iter(rows))  # its message never comes
    writer.commit([writer.write(iter(rows)), None])
    assert (tmp_path / "parts" / "order").read_text().split("\n")[0] == "2" and len((tmp_path / "parts" / "order").read_text().split("\n")) == 3


def test_a_commit_reads_no_records_and_tasks_write_the_directory(spark, tmp_path, monkeypatch):
    writer = archive.PartsWriter(str(tmp_path / "parts"), True, archive.LIMIT)
    message = writer.write(iter([("a", b"1"), ("b", b"2")]))
    (tmp_path / "parts" / f"{message.name}.records").rename(tmp_path / "records")
    writer.commit([message])  # the driver needs the sizes only
    (tmp_path / "records").rename(tmp_path / "parts" / f"{message.name}.records")
    assert archive._write_directory(spark, str(tmp_path / "parts"), archive.LIMIT) == [f"{message.name}.directory", "ending"]


def test_records_across_reads_and_large_entries(spark, tmp_path, monkeypatch):
    rows = [(f"{'n' * 300}{i:05d}", bytes([i % 251]) * (i % 7 * 50_000)) for i in range(1200)] + [("big", b"x" * (archive.HELD + 5))]
    archive.write_archive(spark.createDataFrame(rows, "path string, content binary").repartition(3), str(tmp_path / "a.zip"))
    monkeypatch.setattr(archive, "BUFFER", 1000)
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None and len(z.infolist()) == 1201
        wanted = [(i.filename.encode(), i.CRC, i.file_size, i.header_offset) for i in z.infolist()]
    with open(tmp_path / "a.zip", "rb") as f:
        f.seek(zipfile.ZipFile(tmp_path / "a.zip").start_dir)
        assert [r[:4] for r in archive._records(f, 1201)] == wanted
    found = archive.read_archive(spark, str(tmp_path / "a.zip"))
    assert found.where("crc32(content) <> crc32 OR length(content) <> size").count() == 0 and found.count() == 1201


def test_parts_that_are_copied_lie_packed_and_go_one_by_one(spark, tmp_path, monkeypatch):
    rows = spark.range(2000).select(F.format_string("%05d", "id").alias("path"), F.repeat(F.lit("words "), 300).cast("binary").alias("content"))
    seen, target = [], tmp_path / "a.zip"
    sizes = lambda: {p.name: p.stat().st_size for d in tmp_path.glob("a.zip.parts-*") for p in d.iterdir() if p.suffix in (".part", ".records", ".directory")}
    monkeypatch.setattr(archive, "_join", lambda *x, of=archive._join: seen.append(sizes()) or of(*x))
    monkeypatch.setattr(archive, "remove", lambda *x, of=archive.remove: seen.append(sizes()) or of(*x))
    written = archive.write_archive(rows, str(target))
    before, after = seen
    assert len(before) == 8 and 10 * sum(before.values()) < written.size == target.stat().st_size and after == {}
    with zipfile.ZipFile(target) as z:
        assert z.testzip() is None and len(z.namelist()) == 2000 and z.read("01999") == b"words " * 300


def test_parts_are_joined_as_they_are_where_the_file_system_joins(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "_joins", lambda *_: True)  # it says so and cannot: parts are then copied
    rows = spark.range(300).select("id", F.concat(F.col("id").cast("string"), F.lit("\n")).cast("binary").alias("content")).repartition(7)
    archive.write_file(rows, str(tmp_path / "f"), order="id")
    archive.write_archive(rows.withColumn("path", F.col("id").cast("string")), str(tmp_path / "f.zip"))
    assert (tmp_path / "f").read_text() == "".join(f"{i}\n" for i in range(300))
    with zipfile.ZipFile(tmp_path / "f.zip") as z:
        assert z.testzip() is None and len(z.namelist()) == 300


def test_nothing_exchanged_lies_beside_the_whole(spark, tmp_path, monkeypatch):
    held = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ")
    seen = []

    def join(*x, of=archive._join):
        for _ in range(50):  # files are deleted in the background
            if "shuffle_" not in held():
                break
            time.sleep(0.1)
        seen.append("shuffle_" in held())
        return of(*x)

    monkeypatch.setattr(archive, "_join", join)
    gc.collect()
    archive.write_archive(spark.range(5000).select(F.col("id").cast("string").alias("path"), F.lit(b"x").alias("content")), str(tmp_path / "a.zip"))
    assert seen == [False]
