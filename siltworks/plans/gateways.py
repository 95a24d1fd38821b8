"""Where a finished export goes: a run hands its rows to a gateway, which alone knows how they are delivered.

A gateway's deliveries appear at their path at once, or not at all, and replace what an earlier one left there; discard() removes what an unfinished
one has left. Others can be given to Coordinator; they need these three methods.
"""

from __future__ import annotations

import urllib.parse
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.sources import archive
from siltworks.sources.blobs import Files


class Gateway(Protocol):
    def lines(self, rows: DataFrame, path: str) -> int:
        """Delivers lines (id, line) in order of id; gives their size in bytes."""

    def archive(self, entries: DataFrame, path: str) -> int:
        """Delivers entries (path, content), one for each path; gives the size in bytes."""

    def discard(self, path: str) -> None:
        """Removes what an unfinished delivery to path has left."""


class Folder:
    """A folder: lines as part files by ranges of id, entries as files of their own under their paths; nothing is joined, so all of it is done by tasks.

    Entries' paths are taken as they are but for segments that would lead out of the folder, which are escaped. Tasks write through a
    backend of blobs, made from the folder's URI; a task that runs twice writes the same files again."""

    ENDINGS = ("ndjson", "d")

    def __init__(self, spark: SparkSession, backend=Files):
        self.spark, self.backend = spark, backend

    def lines(self, rows: DataFrame, path: str) -> int:
        held = f"{path}.partial"
        rows.orderBy("id").select("line").write.mode("overwrite").text(held)
        self._appear(held, path)
        return self._size(path)

    def archive(self, entries: DataFrame, path: str) -> int:
        held = f"{path}.partial"
        self.discard(path)
        backend = self.backend(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = []
                for name, content in zip(batch.column(0), batch.column(1), strict=True):
                    data = content.as_py() or b""
                    backend.write(inner_path(name.as_py()), data)
                    sizes.append(len(data))
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["size"])

        size = entries.select("path", "content").mapInArrow(run, "size long").agg(F.sum("size")).first()[0] or 0
        backend.end()
        self._appear(held, path)
        return size

    def discard(self, path: str) -> None:
        archive.remove(self.spark, f"{path}.partial")

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _appear(self, held: str, path: str) -> None:
        """The finished folder under its name. Between the two steps there is none, never a half-written one."""
        (before, files), (after, _) = self._files(held), self._files(path)
        files.mkdirs(before)
        files.delete(after, True)
        if not files.rename(before, after):
            raise OSError(f"{path} cannot be written")

    def _size(self, path: str) -> int:
        at, files = self._files(path)
        return files.getContentSummary(at).getLength()


def inner_path(path: str) -> str:
    """A path below a folder: empty segments, `.` and `..` are escaped."""
    return "/".join(s if s not in ("", ".", "..") else urllib.parse.quote(s or "%").replace(".", "%2E") for s in path.split("/"))
