"""A training corpus from the documents table: toxic documents go, one of each group of near-duplicates stays, repeated passages go,
sources are mixed to their weights, and the tokens are packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import mixing, neardup, packing, substring, toxicity
from siltworks.llm.queries import tokenizer_path


def _with_others(docs: DataFrame) -> DataFrame:
    """The two columns that operators read, and the others in a struct, so that texts travel once."""
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("others"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("whole_row"))
    return toxicity.score(packed, model, carry=("whole_row",)).where("predicted = 0").select("whole_row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each_group(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = substring.deduplicate(_with_others(docs), carry=("others",))
    kept = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("others.n_chars"))}
    return cut.select(*[kept.get(c, F.col(f"others.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_neardup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: A learned filter, sketches and packing are beyond SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
