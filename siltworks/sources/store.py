"""A keyed table store on Parquet snapshots.

Each table is a folder of snapshots. A commit writes new snapshots of the tables that it changes and then one numbered record that
names them all: readers see the whole old or the whole new state. Only one writer can create a number, and one that finds that
a table it has read was changed meanwhile fails with Conflict. Files are reached through Hadoop's file system interface only, so any
store that Spark reads and that can create a file only if it is not there will do.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltworks import schema


def page(df: DataFrame, size: int, *, key: str = "id", after=None, where: Column | None = None) -> DataFrame:
    """The next rows after a key, in key order, with has_more and next_cursor on each row.

    One row more than asked for is read, to tell whether there are more. The cursor row itself need not exist any more. The next
    cursor is null on the last page.
    """
    if size < 1:
        raise ValueError("a page has at least one row")
    if where is not None:
        df = df.where(where)
    if after is not None:
        df = df.where(F.col(key) > F.lit(after))
    ahead = df.orderBy(key).limit(size + 1)
    whole = Window.orderBy(key)  # at most size + 1 rows
    numbered = ahead.withColumn("_n", F.row_number().over(whole)).withColumn("_more", F.count("*").over(Window.partitionBy()) > size)
    out = numbered.where(F.col("_n") <= size)
    last = F.max(F.col(key)).over(Window.partitionBy())
    return out.withColumn("has_more", F.col("_more")).withColumn("next_cursor", F.when(F.col("_more"), last)).drop("_n", "_more")


def query_page(df: DataFrame, size: int, *, state: str | None = None, cursor=None, key: str = "id", state_col: str = "state") -> DataFrame:
    """page() over all rows or those of one state; with a table partitioned by state only that partition is read."""
    return page(df, size, key=key, after=cursor, where=None if state is None else F.col(state_col) == state)


def latest(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last version of each key. max_by keeps one row per key before the exchange, so hot keys do not meet in one task."""
    packed = df.select(F.col(key).alias("_key"), order.alias("_order"), F.struct(*df.columns).alias("_row"))
    return packed.groupBy("_key").agg(F.max_by("_row", "_order").alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those with their keys; of several new rows of a key one counts: the last by `_seq`, without it the one
    with the greatest hash."""
    new = latest(new, key, F.col("_seq") if "_seq" in new.columns else F.xxhash64(*new.columns)).drop("_seq")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """old without the rows of keys; keys that are not there change nothing."""
    return old.join(keys.select(key), key, "left_anti")


def apply_operations(old: DataFrame, operations: DataFrame, key: str) -> DataFrame:
    """old after an ordered list of puts and deletes: seq, kind ('put' or 'delete'), key columns and, for puts, a struct `row`.

    The last operation on a key decides, which is what applying them one after the other comes to.
    """
    last = operations.groupBy(key).agg(F.max_by(F.struct("kind", "row"), "seq").alias("op"))
    kept = old.join(last.select(key), key, "left_anti")
    return kept.unionByName(last.where("op.kind = 'put'").select("op.row.*").select(*old.columns))


class Conflict(RuntimeError):
    """Another writer has committed first."""


class NewerSchema(RuntimeError):
    """A snapshot was written by a version of the schema that this one does not know."""


def climb(df: DataFrame, table: str, version: int, steps: dict[int, schema.Step]) -> DataFrame:
    """Rows of a table as they were written at a version, brought up by all later steps in order. Each step's columns are computed together from
    those of the step before; a table that a step does not name stays as it is."""
    for number in sorted(n for n in steps if n > version):
        changes = steps[number].columns.get(table, {})
        added = {c: F.expr(x) for c, x in changes.items() if x is not None}
        df = df.withColumns(added).drop(*[c for c, x in changes.items() if x is None]) if changes else df
    return df


class Store:
    """Tables by name under one folder.

    A snapshot's name tells the schema version that it was written with. Older ones are brought up by the later steps when they are read, in
    the plan of the reading query; migrate() rewrites them. `tables` and `steps` are the schema's own unless given.
    """

    def __init__(self, spark: SparkSession, root: str, *, tables: dict[str, str] | None = None, steps: dict[int, schema.Step] | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables, self.steps = schema.TABLES if tables is None else tables, schema.MIGRATIONS if steps is None else steps
        self.schema_version = max(self.steps)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._records: dict[int, dict[str, str]] = {}

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.root}/_commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if not s.getPath().getName().startswith(".")) if self._fs.exists(folder) else []

    def _record(self, number: int) -> dict[str, str] | None:
        """Snapshots by table; null while the record is being written."""
        if number not in self._records:
            stream = self._fs.open(self._path(f"{self.root}/_commits/{number:09d}"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if not text.endswith("\n"):
                return None
            self._records[number] = json.loads(text)
        return self._records[number]

    def _current(self, table: str, upto: int | None = None) -> tuple[int, str | None]:
        for number in reversed(self._numbers()):
            if (upto is None or number <= upto) and (name := (self._record(number) or {}).get(table)):
                return number, name
        return 0, None

    def latest_number(self) -> int:
        """The number of the last commit to any table; what is read at it is one state."""
        return max((n for n in self._numbers() if self._record(n) is not None), default=0)

    def version(self, table: str) -> int:
        """The number of the last commit that changed the table."""
        return self._current(table)[0]

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """All rows of a table, as it is now or was at a version."""
        _, name = self._current(table, version)
        wanted = schema.struct(self.tables[table]) if table in self.tables else None
        if name is None:
            if wanted is None:
                raise KeyError(table)
            return self.spark.createDataFrame([], wanted)
        reader, written_at = self.spark.read, self._written_at(name)
        if written_at > self.schema_version:
            raise NewerSchema(f"{table} is of version {written_at}")
        if any(table in s.columns for n, s in self.steps.items() if n > written_at):
            df = climb(reader.parquet(f"{self.root}/{table}/{name}"), table, written_at, self.steps)
            return df.select(*[F.col(f.name).cast(f.dataType) for f in wanted]) if wanted is not None else df
        df = (reader.schema(wanted) if wanted is not None else reader).parquet(f"{self.root}/{table}/{name}")
        return df.select(*wanted.names) if wanted is not None else df

    @staticmethod
    def _written_at(name: str) -> int:
        told = re.match(r"snapshot-\d+-s(\d+)-", name)
        return int(told[1]) if told else schema.UNNAMED_VERSION

    def commit(self, table: str, df: DataFrame, *, base: int | None = None, partition_by: tuple[str, ...] | None = None) -> int:
        """Writes df as the table's next snapshot and makes it current; base is the version that df was made from."""
        return self.commit_all({table: df}, base=base, partition_by=partition_by)

    def commit_all(self, tables: dict[str, DataFrame], *, base: int | None = None, partition_by: tuple[str, ...] | None = None) -> int:
        """The tables' next snapshots become current together, or none of them, if one of them was changed after base (by default: now)."""
        base = self.latest_number() if base is None else base
        names = {}
        for table, df in tables.items():
            names[table] = f"snapshot-{base + 1:09d}-s{self.schema_version}-{uuid.uuid4().hex}"
            by = partition_by if partition_by is not None else (("state",) if table == "resources" else ())
            writer = df.write.mode("errorifexists")
            (writer.partitionBy(*by) if by else writer).parquet(f"{self.root}/{table}/{names[table]}")
        self._fs.mkdirs(self._path(f"{self.root}/_commits"))
        while True:
            later = [n for n in self._numbers() if n > base]
            for n in later:
                record = self._record(n)
                if record is None or record.keys() & names.keys():
                    raise Conflict(", ".join(names))
            number = max(later, default=base) + 1
            try:
                stream = self._fs.create(self._path(f"{self.root}/_commits/{number:09d}"), False)
            except Exception:  # noqa: BLE001 another writer has the number: see what it changed
                if number not in self._numbers():
                    raise
                continue
            stream.write(bytearray((json.dumps(names) + "\n").encode()))
            stream.close()
            return number

    def clear_unfinished(self) -> int:
        """Removes records that a crashed writer has left without an end; only while no other writer is at work."""
        left = [n for n in self._numbers() if self._record(n) is None]
        for n in left:
            self._fs.delete(self._path(f"{self.root}/_commits/{n:09d}"), False)
        return len(left)

    def remove_folder(self, folder: str) -> None:
        """Deletes a folder of working files; one that is not there changes nothing."""
        self._fs.delete(self._path(folder), True)

    def get(self, table: str, key) -> DataFrame:
        """The row of a key, or none; the comparison reaches the Parquet scan."""
        return self.read(table).where(F.col(schema.KEYS[table]) == F.lit(key))

    def count(self, table: str) -> int:
        return self.read(table).count()

    def query(self, size: int, *, state: str | None = None, cursor: str | None = None) -> DataFrame:
        return query_page(self.read("resources"), size, state=state, cursor=cursor)

    def save(self, table: str, rows: DataFrame) -> int:
        base = self.latest_number()
        return self.commit(table, upsert(self.read(table, base), rows, schema.KEYS[table]), base=base)

    def remove(self, table: str, keys: DataFrame) -> int:
        base = self.latest_number()
        return self.commit(table, delete(self.read(table, base), keys, schema.KEYS[table]), base=base)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def put_state(self, key: str, value: str) -> int:
        """Sets one control value; other writers' values are kept, so a conflict is no reason to give up."""
        for _ in range(9):
            try:
                return self.save("control_state", self.spark.createDataFrame([(key, value)], schema.CONTROL_STATE))
            except Conflict:
                continue
        raise Conflict("control_state")

    def get_state(self, key: str) -> str | None:
        row = self.get("control_state", key).first()
        return row["value"] if row else None

    def delete_state(self, key: str) -> int:
        return self.remove("control_state", self.spark.createDataFrame([(key,)], "key STRING"))

    def migrate(self) -> int:
        """Rewrites the tables that a later step has changed and notes the newest version, all in one commit; what is done is not repeated.

        A store that another writer changes meanwhile is left as it is, with Conflict; one that stops half-way keeps its old version and rows.
        """
        base = self.latest_number()
        at = int(self.get_state("schema_version") or 0)
        if at >= self.schema_version:
            return at
        after = {}
        for table in self.tables:
            name = self._current(table, base)[1]
            if name is None:
                continue
            changed = any(table in s.columns for n, s in self.steps.items() if n > self._written_at(name))
            if changed or (table == "resources" and at < 2):  # step 2 changed where its rows lie
                after[table] = self.read(table, base)
        version = self.spark.createDataFrame([("schema_version", str(self.schema_version))], schema.CONTROL_STATE)
        after["control_state"] = upsert(self.read("control_state", base), version, "key")
        self.commit_all(after, base=base)
        return self.schema_version

    def move_legacy_state(self, legacy: DataFrame) -> DataFrame:
        """Copies old control values (key, value) that are not in the store yet, in one commit; gives the keys that may now be deleted at their old
        place. Of values given twice the greatest counts; what is done is not repeated, and without anything new there is no commit."""
        base = self.latest_number()
        known = self.read("control_state", base)
        new = legacy.where("value IS NOT NULL AND key IS NOT NULL").groupBy("key").agg(F.max("value").alias("value")).join(known.select("key"), "key", "left_anti")
        if not new.isEmpty():
            self.commit("control_state", known.unionByName(new.select(*known.columns)), base=base)
        return legacy.select("key").where("key IS NOT NULL").distinct()

    @contextmanager
    def exclusive(self, name: str, *, lease_seconds: int = 3600) -> Iterator[bool]:
        """Whether no other pass of this name is under way; the mark is a file that only one can create, and goes with the pass. A mark that
        is older than the lease was left by a crash and may be taken over."""
        mark = self._path(f"{self.root}/_passes/{name}")
        self._fs.mkdirs(mark.getParent())
        now = self.spark._jvm.java.lang.System.currentTimeMillis()
        if self._fs.exists(mark) and now - self._fs.getFileStatus(mark).getModificationTime() > 1000 * lease_seconds:
            self._fs.delete(mark, False)
        try:
            mine = self._fs.createNewFile(mark)
        except Exception:  # noqa: BLE001 some file systems raise where others answer
            mine = False
        try:
            yield mine
        finally:
            if mine:
                self._fs.delete(mark, False)

    def start_session(self, session: DataFrame) -> int:
        """A session becomes the current one and enters the history under its id."""
        row = session.select(F.lit("current_session").alias("key"), F.to_json(F.struct(*session.columns)).alias("value"))
        base = self.latest_number()
        after = {t: upsert(self.read(t, base), rows, schema.KEYS[t]) for t, rows in (("control_state", row), ("sessions", session))}
        return self.commit_all(after, base=base)


class Transaction:
    """Buffered puts and deletes that are committed together, or not at all; they apply to the state at which the transaction began."""

    def __init__(self, store: Store):
        self.store, self.buffer, self.open, self.base = store, {}, True, store.latest_number()

    def _check(self) -> None:
        if not self.open:
            raise RuntimeError("the transaction is over")

    def put(self, table: str, rows: DataFrame) -> None:
        self._check()
        self.buffer.setdefault(table, []).append(("put", rows))

    def delete(self, table: str, keys: DataFrame) -> None:
        self._check()
        self.buffer.setdefault(table, []).append(("delete", keys))

    def commit(self) -> None:
        self._check()
        self.open, after = False, {}
        for table, steps in self.buffer.items():
            key, ddl = schema.KEYS[table], schema.struct(self.store.tables[table])
            names = ddl.names
            operations = None
            for seq, (kind, rows) in enumerate(steps):
                row = F.struct(*[F.col(c) for c in names]) if kind == "put" else F.lit(None).cast(ddl)
                step = rows.select(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), F.col(key), row.alias("row"))
                operations = step if operations is None else operations.unionByName(step)
            after[table] = apply_operations(self.store.read(table, self.base), operations, key)
        if after:
            self.store.commit_all(after, base=self.base)

    def rollback(self) -> None:
        self._check()
        self.open = False
        self.buffer.clear()
