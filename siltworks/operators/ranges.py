"""Running numbers over a whole table without a task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.session import settle, shuffle_width


def running_before(rows: DataFrame, order: list[str], value: Column, name: str, *, parts: int | None = None) -> DataFrame:
    """rows with the sum of value over all rows before each, in order of the named columns (nulls first).

    Rows are dealt into ranges of the order and kept there; a sum per range and a sum within the range add up. Equal rows of the order
    stay in one range, so the order should tell rows apart. The table of ranges has one row for each and is broadcast.
    """
    dealt = rows.withColumn("_value", value.cast("long")).repartitionByRange(parts or shuffle_width(rows.sparkSession), *order)
    dealt = settle(dealt.withColumn("_range", F.spark_partition_id()))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_sum").over(before.orderBy("_range")), F.lit(0).cast("long"))
    sums = dealt.groupBy("_range").agg(F.sum("_value").alias("_sum")).select("_range", earlier.alias("_earlier"))
    inside = F.coalesce(F.sum("_value").over(before.partitionBy("_range").orderBy(*order)), F.lit(0).cast("long"))
    return dealt.join(F.broadcast(sums), "_range").withColumn(name, F.col("_earlier") + inside).drop("_range", "_value", "_earlier")


def scan(rows: DataFrame, order: list[str], *, by: list[str] | None = None, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """rows with running sums and maxima, each row included, in order of the named columns (nulls first) within equal values of `by`.

    One group of `by` may hold most rows: rows are dealt into ranges of (by, order), so a large group covers several ranges. Sums and maxima
    are associative, so a range only has to know what its first group came to in the ranges before. That takes one row for each range, which is
    broadcast. Equal rows of (by, order) stay in one range and follow each other in any order. Null values count for nothing.
    """
    by = by or []
    columns = {n: F.coalesce(c, F.lit(0)) for n, c in (sums or {}).items()} | (maxima or {})
    dealt = rows.select("*", *[c.alias(f"_in_{n}") for n, c in columns.items()]).repartitionByRange(parts or shuffle_width(rows.sparkSession), *by, *order)
    dealt = settle(dealt.withColumn("_range", F.spark_partition_id()))
    total = lambda n, c: F.sum(c) if n in (sums or {}) else F.max(c)
    group = F.struct(*[F.col(f"`{b}`") for b in by], F.lit(0).alias("_")).alias("_group")
    parts_of = dealt.groupBy("_range", group).agg(*[total(n, f"_in_{n}").alias(n) for n in columns])
    ends = parts_of.groupBy("_range").agg(F.min("_group").alias("_first"), F.max(F.struct("_group", *columns)).alias("_last"))
    # A group that covers several ranges ends all of them but its last, so what a range's first group has had is the sum up to the range before.
    so_far = Window.partitionBy("_last._group").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.select("_range", "_first", F.col("_last._group").alias("_ended"), *[total(n, f"_last.{n}").over(so_far).alias(f"_sum_{n}") for n in columns])
    before = Window.orderBy("_range")  # one row for each range
    same = F.lag("_ended").over(before).eqNullSafe(F.col("_first"))
    carried = F.broadcast(ends.select("_range", "_first", *[F.when(same, F.lag(f"_sum_{n}").over(before)).alias(f"_had_{n}") for n in columns]))
    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(carried, "_range").withColumn("_is_first", group.eqNullSafe(F.col("_first")))
    for n in columns:
        here, had = total(n, f"_in_{n}").over(inside), F.when(F.col("_is_first"), F.col(f"_had_{n}"))
        out = out.withColumn(n, here + F.coalesce(had, F.lit(0)) if n in (sums or {}) else F.greatest(here, had))
    return out.drop("_range", "_is_first", "_first", *[f"_{k}_{n}" for n in columns for k in ("in", "had")])


def page_numbers(rows: DataFrame, size: int, *, key: str = "id") -> DataFrame:
    """rows with the page, from 0, on which each stands when they are read in key order, `size` to a page."""
    if size < 1:
        raise ValueError("a page has at least one row")
    numbered = running_before(rows, [key], F.lit(1), "_before")
    return numbered.withColumn("page_number", F.floor(F.col("_before") / size).cast("long")).drop("_before")
