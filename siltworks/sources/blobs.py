"""A folder of media: bytes in files by kind and id, with a metadata file (sidecar) beside each, written and read by tasks.

A file appears in two steps: a task writes it under media/tmp with a name of its own and then renames it. Bytes come before their sidecar, and a sidecar
goes before its bytes, so whoever reads a sidecar finds bytes. Names follow from ids, so an attempt that runs twice writes the same
files again, and a task that is lost leaves files under media/tmp only, or bytes that no sidecar names; `clean` removes both. Clean only while nothing is
being put.

Defined results: null contents are empty; rows without an id are left out; of repeated ids in one put the one with the greatest digest counts; ids that are
not there are not found, and deleting them changes nothing.
"""

from __future__ import annotations

import os
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.session import settle, shuffle_width
from siltworks.sources import media
from siltworks.sources.archive import open_folder

SIDECARS, UNFINISHED = "media/meta", "media/tmp"


def sidecar_path(media_id: str) -> str:
    return f"{SIDECARS}/{urllib.parse.quote(media_id, safe='')}.json"


def write_file(root: str, path: str, data: bytes) -> None:
    """data at root/path, all of it or nothing."""
    files, folder = open_folder(root)
    target, held = f"{folder}/{path}", f"{folder}/{UNFINISHED}/{uuid.uuid4().hex}"

    def in_folder(name: str, do):
        try:
            return do()
        except FileNotFoundError:  # the first file of its folder
            files.create_dir(name.rsplit("/", 1)[0], recursive=True)
            return do()

    with in_folder(held, lambda: files.open_output_stream(held)) as out:
        out.write(data)
    in_folder(target, lambda: files.move(held, target))


def listed(root: str, within: str) -> Iterator[tuple[str, int, datetime]]:
    """path below root, length, modified of all files below root/within; those of a local folder one by one, however many it holds."""
    files, folder = open_folder(root)
    top = f"{folder}/{within}".rstrip("/")
    if isinstance(files, fs.LocalFileSystem):
        waiting = [top] if os.path.isdir(top) else []
        while waiting:
            with os.scandir(waiting.pop()) as found:
                for e in found:
                    if e.is_dir():
                        waiting.append(e.path)
                        continue
                    try:
                        about = e.stat()
                    except FileNotFoundError:  # removed meanwhile
                        continue
                    yield e.path[len(folder) + 1 :], about.st_size, datetime.fromtimestamp(about.st_mtime, UTC)
    else:
        for x in files.get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True)):
            if x.type == fs.FileType.File:
                yield x.path[len(folder) + 1 :], x.size, x.mtime


def remove_file(root: str, path: str) -> bool:
    files, folder = open_folder(root)
    if files.get_file_info(f"{folder}/{path}").type != fs.FileType.File:
        return False
    files.delete_file(f"{folder}/{path}")
    return True


def read_file(root: str, path: str) -> bytes | None:
    files, folder = open_folder(root)
    if files.get_file_info(f"{folder}/{path}").type != fs.FileType.File:
        return None
    with files.open_input_stream(f"{folder}/{path}") as f:
        return f.read()


class Files:
    """The backend of a store: whole files under a folder, by paths below it. Tasks carry it, so another one must be picklable and have these methods."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, path: str, data: bytes) -> None:
        write_file(self.root, path, data)

    def read(self, path: str) -> bytes | None:
        """A file's bytes; null if there is none."""
        return read_file(self.root, path)

    def remove(self, path: str) -> bool:
        """Whether there was such a file; now there is none."""
        return remove_file(self.root, path)

    def list(self, spark: SparkSession, prefix: str = "") -> DataFrame:
        """path (below the folder), length, modified of the files whose path begins with prefix. A task lists them."""
        root, within = self.root, prefix.rpartition("/")[0]  # only this folder is listed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = [pa.string(), pa.int64(), pa.timestamp("us", tz="UTC")]
            for _ in batches:
                found = (x for x in listed(root, within) if x[0].startswith(prefix))
                while some := list(islice(found, 4096)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], ["path", "length", "modified"])

        one = spark.range(1, numPartitions=1)
        return one.mapInArrow(run, "path string, length long, modified timestamp")

    def end(self) -> None:
        """Removes the folder of unfinished files, once nothing is being written."""
        files, folder = open_folder(self.root)
        if files.get_file_info(f"{folder}/{UNFINISHED}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/{UNFINISHED}")
            if not files.get_file_info(fs.FileSelector(f"{folder}/media")):
                files.delete_dir(f"{folder}/media")


class Spread:
    """A backend over several folders, as buckets that each allow so many requests: a path's CRC-32 tells its folder. The folders and their order stay
    the same for as long as the files do."""

    def __init__(self, *roots: str):
        self.parts = [Files(r) for r in roots]

    def _of(self, path: str) -> Files:
        return self.parts[zlib.crc32(path.encode()) % len(self.parts)]

    def write(self, path: str, data: bytes) -> None:
        self._of(path).write(path, data)

    def read(self, path: str) -> bytes | None:
        return self._of(path).read(path)

    def remove(self, path: str) -> bool:
        # Files of lost tasks lie in the folder of what they were to be, under names of their own.
        return any([p.remove(path) for p in ([self._of(path)] if not path.startswith(UNFINISHED) else self.parts)])

    def list(self, spark: SparkSession, prefix: str = "") -> DataFrame:
        first, *others = [p.list(spark, prefix) for p in self.parts]
        for rows in others:
            first = first.unionByName(rows)
        return first

    def end(self) -> None:
        for p in self.parts:
            p.end()


class BlobStore:
    """Media under root, or wherever the given backend keeps files; every method's work is done by tasks."""

    def __init__(self, spark: SparkSession, root: str | None = None, *, backend=None):
        if (root is None) == (backend is None):
            raise ValueError("either root or backend")
        self.spark, self.backend = spark, Files(root) if backend is None else backend

    def _mapped(self, rows: DataFrame, work, result: str, kind: pa.DataType) -> DataFrame:
        """One row per input row (id and more): id and what work(backend, *row) gives. Done once, whatever is read of it."""
        backend, name = self.backend, result.split()[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for start in range(0, batch.num_rows, 64):  # contents are not held for a whole batch
                    some = [c[start : start + 64] for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.string()), pa.array([work(backend, *row) for row in zip(*some, strict=True)], kind)], ["id", name])

        # A small row may mean a large file, so rows are dealt by number; Spark would join small partitions to one.
        return rows.repartition(shuffle_width(self.spark), F.xxhash64(rows.columns[0])).mapInArrow(run, f"id string, {result}")

    def metadata(self) -> DataFrame:
        """Complete media, from their sidecars."""
        files = self.files(SIDECARS + "/")
        texts = self._mapped(files.select("path", F.col("path").alias("at")), lambda backend, _, path: (backend.read(path) or b"").decode(), "value string", pa.string())
        return media.read_sidecars(texts)

    def files(self, prefix: str = "media/") -> DataFrame:
        """path, length, modified of the files whose path begins with prefix."""
        return self.backend.list(self.spark, prefix)

    def put(self, new: DataFrame, now: str) -> DataFrame:
        """Stores new media (id, type, mime_type, content, source) and gives their metadata; bytes of an overwritten medium of another kind go."""
        one = new.where(F.col("id").isNotNull()).withColumn("content", F.coalesce("content", F.lit(b"")))
        one = one.groupBy("id").agg(F.max_by(F.struct("type", "mime_type", "content", "source"), F.sha2("content", 256)).alias("x")).select("id", "x.*")
        old = settle(self.metadata().select("id", "created_at", F.col("storage_path").alias("old_path")))
        rows = media.put(one, old, now).join(one.select("id", "content"), "id")
        sidecar = F.to_json(F.struct(*[c.split()[0] for c in schema.MEDIA_METADATA.split(", ")]))

        def store(backend, media_id: str, path: str, content: bytes, text: str) -> str:
            backend.write(path, content)
            backend.write(sidecar_path(media_id), text.encode())
            return text

        stored = settle(self._mapped(rows.select("id", "storage_path", "content", sidecar.alias("text")), store, "value string", pa.string()))
        written = media.read_sidecars(stored)
        moved = written.join(old, "id").where("old_path <> storage_path").select("id", "old_path")
        settle(self._mapped(moved, lambda backend, _, path: backend.remove(path), "gone boolean", pa.bool_()))
        return written

    def get(self, ids: DataFrame) -> DataFrame:
        """id, content of those ids (id) whose bytes are there."""
        there = self.metadata().join(ids.select("id").distinct(), "id", "left_semi").select("id", "storage_path")
        return self._mapped(there, lambda backend, _, path: backend.read(path), "content binary", pa.binary()).where("content is not null")

    def exists(self, ids: DataFrame) -> DataFrame:
        """id, exists of each distinct id."""
        there = self.metadata().join(self.files().select(F.col("path").alias("storage_path")), "storage_path", "left_semi").select("id", F.lit(True).alias("exists"))
        return ids.select("id").distinct().join(there, "id", "left").fillna(False, ["exists"])

    def delete(self, ids: DataFrame) -> int:
        """Removes media; gives how many were there."""
        gone = settle(self.metadata().join(ids.select("id").distinct(), "id", "left_semi").select("id", "storage_path"))

        def remove(backend, media_id: str, path: str) -> bool:
            return backend.remove(sidecar_path(media_id)) | backend.remove(path)

        return settle(self._mapped(gone, remove, "gone boolean", pa.bool_())).where("gone").count()

    def verify(self) -> DataFrame:
        """id, ok of all media."""
        metadata = settle(self.metadata())
        content = self._mapped(metadata.select("id", "storage_path"), lambda backend, _, path: backend.read(path), "content binary", pa.binary())
        return media.verify(metadata, metadata.select("id", F.col("storage_path").alias("path")).join(content, "id").select("path", "content"))

    def clean(self) -> DataFrame:
        """Removes what a lost task or an interrupted delete has left, and gives the report of how many of each."""
        files, metadata = settle(self.files()), settle(self.metadata())
        report = settle(media.cleanup_report(metadata, files))
        widows = media.orphan_metadata(metadata, files).select("id")
        for rows in (media.orphan_blobs(files, metadata), media.unfinished(files)):
            settle(self._mapped(rows.select("path", F.col("path").alias("at")), lambda backend, _, path: backend.remove(path), "gone boolean", pa.bool_()))
        settle(self._mapped(widows, lambda backend, media_id: backend.remove(sidecar_path(media_id)), "gone boolean", pa.bool_()))
        return report
