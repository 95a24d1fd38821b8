"""Every catalogued query against its SQL on the same tables."""

import base64
import os

import duckdb
import pandas as pd
import pytest

from siltworks.plans import catalog, operator_catalog


def rows(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda v: "null" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data_dir, name):
    with duckdb.connect() as db:
        for f in os.listdir(data_dir):
            db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data_dir}/{f}'")
        wanted = db.execute(catalog.SQL[name]).df()
    got = catalog.QUERIES[name](spark, data_dir).toPandas()
    assert sorted(got.columns) == sorted(wanted.columns)
    assert rows(got) == rows(wanted)


def test_no_article_of_the_sample_pages_is_a_post(spark, data_dir):
    found = catalog.QUERIES["extract_pages"](spark, data_dir).toPandas()
    assert len(found) and found["strategy"].isna().all() and found["failure"].notna().all()


def test_more_operators_are_catalogued():
    added = {n for n in catalog.QUERIES if hasattr(operator_catalog, n)}
    assert len(added) >= 24 and added <= set(catalog.SQL)


def test_digests_encode_whole_texts(spark, data_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["base64"] for r in catalog.QUERIES["digests"](spark, data_dir).collect()}
    assert max(map(len, texts.values())) > 1000
    assert got == {i: base64.b64encode(t.encode()).decode() for i, t in texts.items()}
