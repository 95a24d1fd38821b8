"""Tables without a folder, for tests and for passes whose results are handed on at once.

Writes are kept as a list of DataFrames and applied when rows are read, in one reduction by key however many they were. Nothing
is persisted: rows are computed again from where they came from. As writes apply at once, a transaction has nothing to commit or to roll back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks import schema
from siltworks.sources.store import apply_operations, query_page


class MemoryStore:
    """The reading and writing part of Store."""

    def __init__(self, spark: SparkSession, *, tables: dict[str, str] | None = None):
        self.spark, self.tables = spark, schema.TABLES if tables is None else tables
        self._operations: dict[str, list[DataFrame]] = {}

    def _add(self, table: str, kind: str, rows: DataFrame) -> None:
        ddl, steps = schema.struct(self.tables[table]), self._operations.setdefault(table, [])
        row = F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ddl]) if kind == "put" else F.lit(None).cast(ddl)
        steps.append(rows.select(F.lit(len(steps)).alias("seq"), F.lit(kind).alias("kind"), F.col(schema.KEYS[table]), row.alias("row")))

    def save(self, table: str, rows: DataFrame) -> None:
        self._add(table, "put", rows)

    def remove(self, table: str, keys: DataFrame) -> None:
        self._add(table, "delete", keys)

    def read(self, table: str) -> DataFrame:
        steps = self._operations.get(table, [])
        none = self.spark.createDataFrame([], schema.struct(self.tables[table]))
        if not steps:
            return none
        operations = steps[0]
        for step in steps[1:]:
            operations = operations.unionByName(step)
        return apply_operations(none, operations, schema.KEYS[table])

    def get(self, table: str, key) -> DataFrame:
        return self.read(table).where(F.col(schema.KEYS[table]) == F.lit(key))

    def count(self, table: str) -> int:
        return self.read(table).count()

    def query(self, size: int, *, state: str | None = None, cursor: str | None = None) -> DataFrame:
        return query_page(self.read("resources"), size, state=state, cursor=cursor)

    def transaction(self) -> AppliedAtOnce:
        return AppliedAtOnce(self)


class AppliedAtOnce:
    """A transaction whose writes are there before it ends, and stay there whichever way it does."""

    def __init__(self, store: MemoryStore):
        self.put, self.delete = store.save, store.remove

    def commit(self) -> None:
        pass

    def rollback(self) -> None:
        pass
