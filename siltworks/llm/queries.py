"""The queries of this package: each operator over its whole table, and SQL for the same rows where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import centroids, chat, fingerprint, license, lm, mixing, neardup, packing, prefixes, quality, sharding, substring, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_edits(_read(spark, sf_dir, "documents"))


def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_read(spark, sf_dir, "documents"))


def op5_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("copies")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), tokenizer_path())


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_read(spark, sf_dir, "documents"), carry=["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents")).drop("text_hash", "root")


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_windows(turns))


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.labelled(centroids.cluster(_read(spark, sf_dir, "embeddings")))


def op12_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_read(spark, sf_dir, "documents"))


def op13_preorder_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(prefixes.prefixes(prefixes.rebuilt(prefixes.turns_in_order(_read(spark, sf_dir, "conversations")))))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_winnowing": op3_winnowing,
    "op4_repetition_coverage": op4_repetition_coverage,
    "op5_suffix_trees": op5_suffix_trees,
    "op6_source_mix": op6_source_mix,
    "op7_certified_packing": op7_certified_packing,
    "op8_histogram_sort": op8_histogram_sort,
    "op9_setsketch": op9_setsketch,
    "op10_chat_windows": op10_chat_windows,
    "op11_delta_lloyd": op11_delta_lloyd,
    "op12_attention_lm": op12_attention_lm,
    "op13_preorder_trie": op13_preorder_trie,
}


def _license_sql() -> str:
    def sql(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    known = ", ".join(f"({sql(i)}, {sql(t)})" for i, t in license.KNOWN)
    x = r"regexp_replace(lower(coalesce(t, '')), '(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$', '', 'g')"
    x = rf"' ' || replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}\n]+', '  ', 'g'), chr(10), '  ' || chr(10) || '  ') || ' '"
    for old, new in license.SPELLINGS:
        x = f"replace({x}, ' {old.replace(' ', '  ')} ', ' {new} ')"
    one = r"trim(regexp_replace({0}, '[ \n]+', ' ', 'g'))"
    return rf"""
WITH known AS (SELECT {one.format('lines')} AS piece, min(license_id) AS license_id FROM (SELECT license_id, {x} AS lines FROM (VALUES {known}) v(license_id, t)) GROUP BY 1),
base AS (SELECT row_number() OVER () AS r, doc_id, {x} AS lines FROM (SELECT doc_id, text AS t FROM documents)),
pieces AS (
  SELECT r, {one.format('p')} AS piece FROM (SELECT r, unnest(string_split(lines, chr(10))) AS p FROM base)
  UNION ALL SELECT r, {one.format('p')} FROM (SELECT r, unnest(string_split_regex(lines, '\n *\n')) AS p FROM base) WHERE contains(trim(p, ' '), chr(10))
  UNION ALL SELECT r, {one.format('lines')} FROM base),
hits AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS licenses, count(*) AS n FROM pieces JOIN known USING (piece) GROUP BY r)
SELECT doc_id, sha256({one.format('lines')}) AS text_digest, known.license_id AS whole_license, coalesce(licenses, '') AS licenses, coalesce(n, 0) AS n_notices
FROM base LEFT JOIN hits USING (r) LEFT JOIN known ON known.piece = {one.format('lines')}"""


def _lloyd_sql(k: int = centroids.K, rounds: int = centroids.ROUNDS, dims: int = centroids.DIMS, scale: int = centroids.SCALE) -> str:
    """All vectors against all centroids in every round."""
    nearest = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(v, w)])::BIGINT"
    steps = [
        f"""x AS (SELECT row_number() OVER () AS r, vec_id, [floor({scale} * e::DOUBLE)::BIGINT FOR e IN embedding] AS v FROM embeddings
WHERE len(embedding) = {dims} AND len([1 FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0)""",
        f"c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1)::INTEGER AS cluster, v AS w FROM x QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) <= {k})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS (SELECT r, min(struct_pack(distance := {nearest}, cluster := cluster)) AS best FROM x, c{i} GROUP BY r)")
        if i < rounds:
            steps.append(f"p{i} AS (SELECT best.cluster AS cluster, unnest(v) AS e, generate_subscripts(v, 1) AS place FROM x JOIN a{i} USING (r))")
            steps.append(f"m{i} AS (SELECT cluster, place, sum(e) AS s, count(*) AS n FROM p{i} GROUP BY ALL)")
            steps.append(f"n{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS w FROM m{i} GROUP BY cluster)")
            steps.append(f"c{i + 1} AS (SELECT cluster, coalesce(n{i}.w, c{i}.w) AS w FROM c{i} LEFT JOIN n{i} USING (cluster))")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.cluster AS cluster, best.distance AS distance, sum(best.distance) OVER (PARTITION BY best.cluster)::BIGINT AS cluster_inertia, sum(best.distance) OVER ()::BIGINT AS inertia,
sha256(array_to_string(w, ',')) AS centroid_sha256, count(*) OVER (PARTITION BY best.cluster) AS cluster_size FROM x JOIN a{rounds} USING (r) JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""


SQL = {"op1_license_scan": _license_sql(), "op11_delta_lloyd": _lloyd_sql()}
