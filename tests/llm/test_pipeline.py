"""The pipeline against a composition of plain restatements."""

from collections import Counter

import corpus_pipeline
from siltworks.llm import mixing, packing, queries, toxicity
from tests.llm import helpers as h


def test_stages_keep_the_columns_and_do_their_work(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    names, by_stage = docs.columns, {}
    model = toxicity.fit(docs, spark.read.parquet(f"{data_dir}/labels.parquet"))
    clean = {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data_dir)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        by_stage[name] = docs.collect()
        if name != "packing":
            assert docs.columns == names
    texts = {r["doc_id"]: r["text"] for r in by_stage["toxicity"]}
    assert set(texts) == clean
    least = {i for i, (_, c) in h.near_components(list(texts.items())).items() if i == c}
    assert {r["doc_id"] for r in by_stage["minhash_neardup"]} == least
    cut = h.without_repeats([(i, texts[i]) for i in least])
    for r in by_stage["substring_dedup"]:
        _, removed, kept = cut[r["doc_id"]]
        assert r["text"] == (" ".join(kept) if removed else texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    copies = Counter(r["doc_id"] for r in by_stage["source_mix"])
    before = spark.createDataFrame(by_stage["substring_dedup"])
    assert copies == Counter({r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]})
    encode = packing.encoder(queries.tokenizer_path()).encode
    tokens = sum(len(encode(r["text"])) // 4 + 1 for r in by_stage["source_mix"])
    assert sum(r["length"] for r in by_stage["packing"]) == tokens
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, data_dir).count() == len(by_stage["packing"])


ROWS = [
    *[(i, " ".join(f"{i}w{j}" for j in range(60)), "en", "s" if i % 2 else None, 0) for i in range(20)],
    (20, None, "en", "s", None),
    (21, "", None, None, 0),
    (22, " \n\t", "en", "s", 3),
    (23, "one two", "en", "s", 7),
    (24, "one two", "en", "s", 7),
    (25, " ".join(f"v{j}" for j in range(20_000)), "en", "t", 0),
    (0, " ".join(f"0w{j}" for j in range(60)), "en", None, 0),  # the first row again
    (None, "a text without an id", None, None, None),
]


def test_odd_and_no_rows(spark, data_dir, tmp_path):
    kind = spark.read.parquet(f"{data_dir}/labels.parquet").schema
    docs = spark.read.parquet(f"{data_dir}/documents.parquet").schema
    for name, rows in (("odd", ROWS), ("none", [])):
        folder = str(tmp_path / name)
        odd = spark.createDataFrame([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows], docs)
        odd.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], kind).write.parquet(f"{folder}/labels.parquet")  # nothing is labelled: the grammar alone judges
        names, left = odd.columns, {}
        docs_now = odd
        for stage, function in corpus_pipeline.STAGES:
            docs_now = function(spark, docs_now, folder)
            docs_now = spark.createDataFrame(docs_now.collect(), docs_now.schema)
            left[stage] = docs_now.collect()
            if stage != "packing":
                assert docs_now.columns == names
        if not rows:
            assert not any(left.values())
            continue
        assert len(left["toxicity"]) == len(ROWS)  # nothing here is toxic
        ids = [r["doc_id"] for r in left["minhash_neardup"]]
        assert {23, 25, None} <= set(ids) and 24 not in ids and ids.count(0) >= 1
        assert all(r["text"] == dict((x[0], x[1]) for x in ROWS)[r["doc_id"]] for r in left["substring_dedup"] if r["doc_id"] != 0)
        assert max(Counter(r["doc_id"] for r in left["source_mix"]).values()) <= 2 * 2
        assert {r["doc_id"] for r in left["packing"]} == {r["doc_id"] for r in left["source_mix"]}
        assert corpus_pipeline.run(spark, folder).count() == len(left["packing"])
