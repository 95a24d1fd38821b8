"""Single files from many tasks: archives and joined texts, written and read as a Python data source.

Rows (path, content) come in ranges of the path. Each task writes one part file: for an archive, local headers and stored bodies with their CRC-32,
and beside it the records of the directory with offsets from the part's start; rows of one path that follow each other are one entry, appended in order. When all
tasks are done, the parts' sizes give their offsets, other tasks write each part's piece of the directory, and the parts and pieces are joined. Attempts write
files under names of their own, and only those of the attempt that counts are named in the commit, so a task that is lost or runs twice leaves nothing in the archive.

Parts are joined by the file system where it can (concat), else copied as a stream of bytes; parts that are to be copied lie compressed until then, and each is deleted
when it has been copied, so beside the whole there is little. Tasks open files by URI through pyarrow, so folders may be in any store that pyarrow opens; all must be shared between the driver and the tasks.

Defined results: null contents are empty; rows without a path are left out; an empty table gives an empty archive or file; sizes and offsets beyond 32 bits and more than
65,535 entries are written as ZIP64.
"""

from __future__ import annotations

import shutil
import struct
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, groupby
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from siltworks.session import release, shuffle_width

# Fixed values of the format: signatures, the flag of names in UTF-8, 1980-01-01, and limits of short fields.
LOCAL, CENTRAL, END, END_64, LOCATOR_64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
UTF8_NAMES, FIRST_DAY = 0x800, 0x21
LIMIT, MANY = 0xFFFFFFFF, 0xFFFF

#: Bytes of an entry that are held in memory; more go to the task's own scratch file until the entry is written.
HELD = 32 << 20
#: Bytes of entries that one task reads, about.
SPLIT = 64 << 20
SCHEMA = "place long, path string, size long, crc32 long, content binary"
KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
#: Bytes read or written together, what a field of a record holds at most, and room for the fields before a body.
BUFFER, LIMIT_OF_FIELD, ROOM = 1 << 20, 0xFFFF, 64
#: A directory's record in a part: CRC-32, size, offset in the part, bytes of the name that follows.
RECORD = struct.Struct("<IQQI")
#: How records, and parts that wait for being copied, are compressed.
PACKING = "zstd"


@lru_cache(maxsize=64)
def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def local_header(name: bytes, crc: int, size: int) -> bytes:
    big = size >= LIMIT
    extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
    short = LIMIT if big else size
    return struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, UTF8_NAMES, 0, 0, FIRST_DAY, crc, short, short, len(name), len(extra)) + name + extra


def central_record(name: bytes, crc: int, size: int, offset: int, limit: int = LIMIT) -> bytes:
    wide = ([size, size] if size >= limit else []) + ([offset] if offset >= limit else [])
    extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *wide) if wide else b""
    short, at = (LIMIT if size >= limit else size), (LIMIT if offset >= limit else offset)
    version = 45 if wide else 20
    return struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, version, version, UTF8_NAMES, 0, 0, FIRST_DAY, crc, short, short, len(name), len(extra), 0, 0, 0, 0, at) + name + extra


def ending(n: int, size: int, offset: int, limit: int = LIMIT) -> bytes:
    wide = b""
    if n >= MANY or size >= limit or offset >= limit:
        wide = struct.pack("<IQHHIIQQQQ", END_64, 44, 45, 45, 0, 0, n, n, size, offset) + struct.pack("<IIQI", LOCATOR_64, 0, offset + size, 1)
    return wide + struct.pack("<IHHHHIIH", END, 0, 0, min(n, MANY), min(n, MANY), LIMIT if size >= limit else size, LIMIT if offset >= limit else offset, 0)


@dataclass
class Part(WriterCommitMessage):
    name: str
    n: int
    size: int


class PartsWriter(DataSourceWriter):
    def __init__(self, folder: str, zipped: bool, limit: int, packed: bool = False):
        self.folder, self.zipped, self.limit, self.packing = folder, zipped, limit, PACKING if packed else None

    def write(self, rows: Iterator) -> Part:
        files, folder = open_folder(self.folder)
        files.create_dir(folder, recursive=True)
        name, n, at = uuid.uuid4().hex, 0, 0
        with files.open_output_stream(f"{folder}/{name}.part", compression=self.packing, buffer_size=BUFFER) as out, files.open_output_stream(f"{folder}/{name}.records", compression=PACKING, buffer_size=BUFFER) as records:
            for path, some in groupby((r for r in rows if r[0] is not None), key=itemgetter(0)):
                held, body, crc, size = [], None, 0, 0
                try:
                    for r in some:
                        content = bytes(r[1] or b"")
                        crc, size = zlib.crc32(content, crc), size + len(content)
                        if body is None and size > HELD:
                            body = tempfile.TemporaryFile()
                            body.writelines(held)
                        (held.append if body is None else body.write)(content)
                    header, encoded = b"", path.encode()
                    if self.zipped:
                        header = local_header(encoded, crc, size)
                        records.write(RECORD.pack(crc, size, at, len(encoded)) + encoded)
                    if body is None:
                        out.write(b"".join([header, *held]))
                    else:
                        out.write(header)
                        body.seek(0)
                        shutil.copyfileobj(body, out, BUFFER)
                finally:
                    if body is not None:
                        body.close()
                n, at = n + 1, at + len(header) + size
        return Part(name, n, at)

    def commit(self, messages: list[Part | None]) -> None:
        files, folder = open_folder(self.folder)
        files.create_dir(folder, recursive=True)
        parts = [m for m in messages if m is not None and m.n]  # in order of the ranges
        with files.open_output_stream(f"{folder}/sizes") as out:
            out.write("\n".join(f"{p.name} {p.n} {p.size}" for p in parts).encode())
        with files.open_output_stream(f"{folder}/order") as out:
            out.write("\n".join([str(sum(p.n for p in parts)), *[f"{p.name}.part" for p in parts], *["directory"] * self.zipped]).encode())

    def abort(self, messages: list[Part | None]) -> None:
        files, folder = open_folder(self.folder)
        for m in messages:
            for kind in ("part", "records") if m is not None else ():
                if files.get_file_info(f"{folder}/{m.name}.{kind}").type == fs.FileType.File:
                    files.delete_file(f"{folder}/{m.name}.{kind}")


class BatchesWriter(DataSourceArrowWriter):
    """The same, given rows in Arrow batches."""

    def __init__(self, parts: PartsWriter):
        self.parts = parts

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        return self.parts.write(r for batch in iterator for r in zip(*[c.to_pylist() for c in batch.columns], strict=True))

    def commit(self, messages: list[Part | None]) -> None:
        self.parts.commit(messages)

    def abort(self, messages: list[Part | None]) -> None:
        self.parts.abort(messages)


def _directory_piece(uri: str, name: str, base: int, limit: int, packed: bool = False) -> int:
    """Writes a part's piece of the directory; gives its size."""
    files, folder = open_folder(uri)
    size, held = 0, f"{folder}/{name}.{uuid.uuid4().hex}"
    with files.open_input_stream(f"{folder}/{name}.records", compression=PACKING, buffer_size=BUFFER) as records, files.open_output_stream(held, compression=PACKING if packed else None, buffer_size=BUFFER) as out:
        while head := records.read(RECORD.size):
            crc, length, at, width = RECORD.unpack(head)
            size += out.write(central_record(records.read(width), crc, length, base + at, limit))
    files.move(held, f"{folder}/{name}.directory")
    return size


def _directory_pieces(uri: str, limit: int, packed: bool):
    """For rows (name, base) of parts: each part's piece of the directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [_directory_piece(uri, name, base, limit, packed) for name, base in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["size"])

    return run


def _write_directory(spark: SparkSession, folder: str, limit: int, packed: bool = False) -> list[str]:
    """The directory in pieces, one for each part and the ending, written by tasks; gives their names in order. The records then go."""
    files, at = open_folder(folder)
    with files.open_input_stream(f"{at}/sizes") as f:
        parts = [(name, int(n), int(size)) for name, n, size in (x.split() for x in f.read().decode().splitlines())]
    bases = [0, *accumulate(size for _, _, size in parts)]
    size = 0
    if parts:
        rows = spark.createDataFrame([(name, base) for (name, _, _), base in zip(parts, bases[:-1], strict=True)], "name string, base long").repartition(len(parts))
        size = rows.mapInArrow(_directory_pieces(folder, limit, packed), "size long").agg(F.sum("size")).first()[0]
    for name, _, _ in parts:
        files.delete_file(f"{at}/{name}.records")
    with files.open_output_stream(f"{at}/ending", compression=PACKING if packed else None) as out:
        out.write(ending(sum(n for _, n, _ in parts), size, bases[-1], limit))
    return [*[f"{name}.directory" for name, _, _ in parts], "ending"]


@dataclass
class Slice(InputPartition):
    """Entries from a place of the directory on, and how many."""

    start: int
    first: int
    n: int


#: What a directory's record says before its name: CRC-32, both sizes, the lengths of what follows, and the offset.
FIXED_PART, HEAD = 46, struct.Struct("<16xIIIHHH8xI")


def _records(stream, n: int) -> Iterator[tuple[bytes, int, int, int, int]]:
    """name, crc, size, offset and the record's own length, of n records of a directory."""
    data, at, longest, more_to_come = b"", 0, 3 * LIMIT_OF_FIELD + FIXED_PART, True
    for _ in range(n):
        if more_to_come and len(data) - at < longest:
            following = stream.read(max(BUFFER, longest))
            data, at, more_to_come = data[at:] + following, 0, bool(following)
        crc, packed, size, width, more, remark, offset = HEAD.unpack_from(data, at)
        start, whole = at + FIXED_PART, size
        if more and (size == LIMIT or offset == LIMIT):
            extra, i = data[start + width : start + width + more], 0
            while i + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, i)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{length // 8}Q", extra, i + 4))
                    if size == LIMIT:
                        whole = wide[0]
                        wide = wide[2:] if packed == LIMIT else wide[1:]
                    if offset == LIMIT:
                        offset = wide[0]
                i += 4 + length
        yield data[start : start + width], crc, whole, offset, FIXED_PART + width + more + remark
        at = start + width + more + remark


class EntriesReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Slice]:
        files, path = open_folder(self.uri)
        with files.open_input_file(path) as f:
            tail = min(f.size(), 66_000)
            f.seek(f.size() - tail)
            data = f.read(tail)
            at = data.rfind(struct.pack("<I", END))
            if at < 0:
                raise ValueError(f"{self.uri} is no archive")
            _, _, _, _, n, _, offset, _ = struct.unpack_from("<IHHHHIIH", data, at)
            if at >= 20 and struct.unpack_from("<I", data, at - 20)[0] == LOCATOR_64:
                f.seek(struct.unpack_from("<IIQI", data, at - 20)[2])
                wide = struct.unpack("<IQHHIIQQQQ", f.read(56))
                n, offset = wide[7], wide[9]
            f.seek(offset)
            slices, where, held = [Slice(offset, 0, 0)], offset, 0
            for i, (_, _, size, _, length) in enumerate(_records(f, n)):
                if held and held + size > SPLIT:
                    slices.append(Slice(where, i, 0))
                    held = 0
                slices[-1].n += 1
                where, held = where + length, held + size
        return slices

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        files, path = open_folder(self.uri)
        out, held = [], 0
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        packed = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], names)
        with files.open_input_file(path) as directory, files.open_input_file(path) as bodies:
            directory.seek(part.start)
            window, begin = b"", 0  # entries follow each other in most archives
            for i, (name, crc, size, offset, _) in enumerate(_records(directory, part.n)):
                if not begin <= offset <= begin + len(window) - 30 - size - len(name) - ROOM:
                    bodies.seek(offset)
                    window, begin = bodies.read(max(BUFFER, 30 + size + len(name) + ROOM)), offset
                width, extra = struct.unpack_from("<HH", window, offset - begin + 26)
                start = offset - begin + 30 + width + extra
                if start + size > len(window):
                    bodies.seek(begin + start)
                    content = bodies.read(size)
                else:
                    content = window[start : start + size]
                out.append((part.first + i, name.decode(), size, crc, content))
                held += size
                if held >= BUFFER or len(out) >= 4096:
                    yield packed()
                    out, held = [], 0
        if out:
            yield packed()


class OneFile(DataSource):
    """Format "onefile": writes parts of an archive or (zipped = false) of a plain file into a folder; reads the entries of an archive."""

    @classmethod
    def name(cls) -> str:
        return "onefile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return EntriesReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BatchesWriter(PartsWriter(self.options["path"], self.options.get("zipped", "true") == "true", int(self.options.get("limit", LIMIT)), self.options.get("packed") == "true"))


class OneFileWritten(NamedTuple):
    entries: int
    size: int


def remove(spark: SparkSession, uri: str) -> None:
    """Removes a file or folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _joins(spark: SparkSession, uri: str) -> bool:
    """Whether the file system says that it can join files without copying them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).hasPathCapability(path, "fs.capability.paths.concat")


def _copy(spark: SparkSession, files, parts: list, out, packed: bool) -> None:
    """Appends parts to a stream; each is deleted before the next."""
    jvm = spark._jvm
    for p in parts:
        part = jvm.com.github.luben.zstd.ZstdInputStream(files.open(p)) if packed else files.open(p)
        try:
            jvm.org.apache.commons.io.IOUtils.copyLarge(part, out)
        finally:
            part.close()
        files.delete(p, False)


def _join(spark: SparkSession, folder: str, target: str, limit: int, packed: bool) -> OneFileWritten:
    """Joins the parts that a commit has named, and an archive's directory, to one file, which then appears under its name at once."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    configuration = spark._jsc.hadoopConfiguration()
    whole = path(f"{folder}/whole")
    files = whole.getFileSystem(configuration)
    stream = files.open(path(f"{folder}/order"))
    entries, *names = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
    stream.close()
    if names[-1:] == ["directory"]:
        names[-1:] = _write_directory(spark, folder, limit, packed)
    parts, copied = [path(f"{folder}/{n}") for n in names], packed
    files.create(whole, True).close()
    if not packed:
        try:
            array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
            for i, p in enumerate(parts):
                array[i] = p
            if parts:
                files.concat(whole, array)
        except Exception as error:  # some say that they can and cannot
            if "UnsupportedOperation" not in type(error).__name__ + str(error):
                raise
            copied = True
    if copied:
        out = files.create(whole, True)
        try:
            _copy(spark, files, parts, out, packed)
        finally:
            out.close()
    size = files.getFileStatus(whole).getLen()
    end = path(target)
    files.delete(end, False)
    if not files.rename(whole, end):
        raise OSError(f"{target} cannot be written")
    return OneFileWritten(int(entries), size)


def _write(rows: DataFrame, order: list[str], target: str, zipped: bool, limit: int) -> OneFileWritten:
    spark = rows.sparkSession
    spark.dataSource.register(OneFile)
    folder, packed = f"{target}.parts-{uuid.uuid4().hex}", not _joins(spark, target)
    try:
        # All rows of a path go to one task, so that they can become one entry there.
        dealt = rows.repartitionByRange(shuffle_width(spark), order[0]).sortWithinPartitions(*order).select("path", "content")
        dealt.write.format("onefile").option("zipped", str(zipped).lower()).option("limit", str(limit)).option("packed", str(packed).lower()).mode("append").save(folder)
        release(spark)  # nothing that was exchanged is needed beside the whole
        return _join(spark, folder, target, limit, packed)
    finally:
        remove(spark, folder)


def write_archive(rows: DataFrame, target: str, *, order: tuple[str, ...] = (), limit: int = LIMIT) -> OneFileWritten:
    """rows (path, content) as an archive with entries by path; rows of a path are appended in the given order. """
    return _write(rows, ["path", *order], target, True, limit)


def write_file(rows: DataFrame, target: str, *, order: str) -> OneFileWritten:
    """The contents (content) of rows, one behind the other by an ordering column, as one file."""
    return _write(rows.withColumn("path", rows[order].cast("string")), [order], target, False, LIMIT)


def read_archive(spark: SparkSession, uri: str) -> DataFrame:
    """place, path, size, crc32, content of the entries of an archive, read in slices."""
    spark.dataSource.register(OneFile)
    return spark.read.format("onefile").load(uri)
