"""First occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order. One candidate per key and task is exchanged, so hot keys are cheap."""
    packed = df.select(F.col(key).alias("_key"), F.struct(*order).alias("_order"), F.struct(*df.columns).alias("_row"))
    return packed.groupBy("_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*")


def enqueue(known: DataFrame, batch: DataFrame, *, uri: str = "target_uri", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """New rows of a batch, the first of each address that is not known yet; and one row with how many were duplicates."""
    firsts = first_per_key(batch, uri, [order]).join(known.select(uri).distinct(), uri, "left_anti")
    counted = batch.agg(F.count("*").alias("n")).select("n", F.lit(0).cast("long").alias("new")).unionByName(firsts.agg(F.count("*").alias("new")).select(F.lit(0).cast("long").alias("n"), "new"))
    return firsts, counted.agg((F.sum("n") - F.sum("new")).alias("duplicates"))
