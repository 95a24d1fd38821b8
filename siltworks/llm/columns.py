"""Column helpers of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than these six; as a Java pattern.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names that cannot clash with others of df."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def edges_below(edges: list[int], x: Column) -> Column:
    """How many of the ascending edges are below x; two short scans, over the last edges of equal runs and over one run."""
    if not edges:
        return F.lit(0)
    run = max(1, round(len(edges) ** 0.5))
    as_array = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")  # noqa: E731 one folded constant
    runs = F.size(F.filter(as_array(edges[run - 1 :: run]), lambda e: e < x))
    return runs * run + F.size(F.filter(F.slice(as_array(edges), runs * run + 1, run), lambda e: e < x))
