"""Delta Lloyd against the plain algorithm."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from siltworks.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, cluster int, vector string"


def plain(rows, k, rounds, dims):
    kept = [(i, [max(-centroids.LIMIT, min(centroids.LIMIT, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest()
    centers = [v for _, v in sorted(kept, key=lambda x: (digest(x[0]), x[1]))[:k]]
    for step in range(rounds + 1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers)) for _, v in kept]
        if step < rounds:
            groups = [[v for (_, v), (_, j) in zip(kept, best, strict=True) if j == n] for n in range(len(centers))]
            centers = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centers, strict=True)]
    return sorted(((i, j, d, sum(e for e, n in best if n == j), sum(e for e, _ in best), hashlib.sha256(",".join(map(str, centers[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, best, strict=True)), key=str)


@pytest.mark.parametrize("rounds", [0, 3])
def test_odd_vectors(spark, rounds):
    r = random.Random(rounds)
    rows = [(i % 40, [float(r.choice([-0.02, 0.5, 1, 3])) for _ in range(4)]) for i in range(90)]
    rows += [(100, None), (101, []), (102, [1.0, 2.0, None, 1.0]), (103, [1.0, 2.0, math.nan, 1.0]), (104, [1.0, math.inf, 1.0, 1.0]), (105, [1.0] * 5), (None, [9.0] * 4), (106, [1e30, -1e30, 0.0, 1.0])]
    got = centroids.labelled(centroids.cluster(spark.createDataFrame([(*x, 5, "v") for x in rows], SCHEMA), k=5, rounds=rounds, dims=4)).drop("cluster_size")
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, 5, rounds, 4)


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(1, [0.5, 1.0], 0, ""), (2, [0.5, 1.0], 0, "")], SCHEMA)
    assert [(r["cluster"], r["distance"]) for r in centroids.labelled(centroids.cluster(few, dims=2)).collect()] == [(0, 0), (0, 0)]
    assert centroids.labelled(centroids.cluster(few.where("false"), dims=2)).collect() == []


def test_rounds_compare_only_what_changed():
    r = np.random.default_rng(1)
    x, old = r.integers(-50, 50, (500, 8)), r.integers(-50, 50, (6, 8))
    cluster, distance = centroids.reassign(x, np.full(500, -1), np.full(500, -1), old, np.ones(6, bool))
    new, changed = old.copy(), np.array([False, True, False, False, True, False])
    new[changed] += 7
    got = centroids.reassign(x, cluster, distance, new, changed)
    d = ((x[:, None] - new[None]) ** 2).sum(2)
    assert (got[0] == d.argmin(1)).all() and (got[1] == d.min(1)).all()


def test_query_equals_sql(spark, data_dir):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data_dir}/embeddings.parquet'")
        got = queries.op11_delta_lloyd(spark, data_dir)
        wanted = db.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL['op11_delta_lloyd']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(wanted)
