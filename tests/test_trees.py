"""Ancestors by doubling: deep chains, wide trees and cycles."""

import random

import pytest
from pyspark.sql import functions as F

from siltworks.operators import connector, normalize


def plain(parents):
    out = []
    for i in parents:
        at, depth = i, 0
        while parents.get(at) is not None:
            at, depth = parents[at], depth + 1
            out.append((i, at, depth))
    return sorted(out)


def test_random_forest(spark):
    r = random.Random(1)
    parents = {i: (r.choice([None, *range(i)]) if i else None) for i in range(60)} | {70: 999}
    edges = spark.createDataFrame(list(parents.items()), "id long, parent_id long")
    all_pairs = plain(parents)
    assert sorted(map(tuple, normalize.descendants(edges).collect())) == all_pairs
    last = {i: (i, 0) for i in parents} | {i: (a, d) for i, a, d in sorted(all_pairs, key=lambda x: x[2])}
    assert {(x["id"], x["top"], x["depth"]) for x in normalize.tops(edges).collect()} == {(i, a, d) for i, (a, d) in last.items()}


def test_a_chain_of_100_000(spark):
    edges = spark.range(100_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    got = normalize.tops(edges)
    assert got.where("top <> 0 or depth <> id").count() == 0 and got.count() == 100_000


def test_cycles_and_no_rows(spark):
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None)], "id long, parent_id long")
    for f in (normalize.descendants, normalize.tops):
        with pytest.raises(normalize.Cycle):
            f(cycle)
        assert f(cycle.where("false")).collect() == []


def test_rows_of_a_tree_are_made_in_one_step(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    page = '<article><a href="/p/K{0}/">p</a><header><a role="link" href="/c">c</a></header><img src="/a{0}.png" width="640"><img src="/b{0}.png" width="640"></article>'
    pages = spark.createDataFrame([(i, "https://www.instagram.com/", page.format(i)) for i in range(5)] + [(9, "https://www.instagram.com/", "<article>x<img src='/a.png'></article>")], "page_id long, url string, html string")
    found, _ = connector.resources(pages.mapInArrow(count, pages.schema), F.lit("2030-01-01T00:00:00.000Z"))
    rows = normalize.adjacency(found).select("id", "parent_id", "child_pos", "depth", "kind").collect()
    assert len(rows) == 6 + 5 * 2 and made.value == 6
    assert sorted((r["child_pos"], r["depth"]) for r in rows if r["parent_id"] == "ig_K3") == [(0, 1), (1, 1)]
    without = normalize.adjacency(found.withColumn("children", F.lit(None).cast(found.schema["children"].dataType)))
    assert without.count() == 6 and without.where("depth > 0").count() == 0
