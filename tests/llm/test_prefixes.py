"""The trie of conversation prefixes against one built node by node."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from siltworks.llm import prefixes, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth int, path string"
CONTRACT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    said = {}
    for c, t, r, x in rows:
        if c is not None:
            said.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    said = {c: [v[2:] for v in sorted(turns)] for c, turns in said.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 9
    whole = {c: said.get(c - c % 5, [])[: h(c)] + turns[h(c) :] for c, turns in said.items()}
    members, children, leaves, saved = {}, {}, {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for n in members:
        if n:
            children.setdefault(n[:-1], []).append(n)
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children.get(n, ())) or 1
        saved[n] = sum(saved[k] for k in children.get(n, ())) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    ends = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(members[n]) if len(whole[c]) == len(n)).encode()).hexdigest()
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children.get(n, ())), leaves[n], saved[n], ends(n)) for n, m in members.items()), key=str)


def built(spark, rows):
    table = spark.createDataFrame([(*x, 3, "p") for x in rows], SCHEMA)
    return prefixes.trie(prefixes.prefixes(prefixes.rebuilt(prefixes.turns_in_order(table)))).collect()


def test_against_plain(spark):
    r = random.Random(5)
    rows = [(r.choice([None, -7, -5, 0, 1, 2, 5, 6, 7, 8, 9, 10, 12, 25]), r.choice([None, 0, 1, 2, 3, 4]), r.choice([None, "user", "assistant"]), r.choice([None, "", "a", "b", "é"])) for _ in range(90)]
    rows += [(40 + i, t, "user", "the same") for i in range(5) for t in range(30)] + [(60, 0, "user", "x" * 5000)]
    got = built(spark, rows)
    assert sorted((tuple(x[c] for c in CONTRACT) for x in got), key=str) == plain(rows)
    by_rank = sorted(got, key=lambda x: x["rank"])
    assert [x["rank"] for x in by_rank] == list(range(len(got)))
    for x in by_rank:  # an interval holds the subtree, and only it
        inside = by_rank[x["rank"] + 1 : x["subtree_end"] + 1]
        assert all(y["depth"] > x["depth"] for y in inside) and sum(y["n_children"] == 0 for y in [x, *inside]) == x["n_leaves"]
        assert x["subtree_end"] + 1 == len(got) or by_rank[x["subtree_end"] + 1]["depth"] <= x["depth"]


def test_no_conversations(spark):
    assert built(spark, []) == [] and built(spark, [(None, 1, "user", "x")]) == []


def test_heavy_values_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "HEAVY", 3)
    many = spark.createDataFrame([("a", i) for i in range(8)] + [("b", 8), ("c", 9), ("d", 10), (None, 11)], "k string, i int")
    one = spark.createDataFrame([("a", 8, 1), ("b", 1, 2), ("c", 1, 3)], "k string, w long, v int")
    got = lambda how: sorted((r["i"], r["v"]) for r in prefixes.join_by_weight(many, one, "k", "w", how).collect())
    inner = [(i, 1) for i in range(8)] + [(8, 2), (9, 3)]
    assert got("inner") == inner and got("left") == [*inner, (10, None), (11, None)]


def test_digest_of_many_ends_in_pieces(spark):
    ends = spark.range(300).select(F.when(F.col("id") < 250, F.lit("hot")).otherwise(F.concat(F.lit("p"), F.col("id"))).cast("binary").alias("path"), F.col("id").alias("conv_id"))
    got = {bytes(r["path"]).decode(): r["ends_sha256"] for r in prefixes.ends_digests(ends, piece=50).collect()}
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {"hot": digest(range(250))} | {f"p{i}": digest([i]) for i in range(250, 300)}


def test_query(spark, data_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{data_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_preorder_trie(spark, data_dir).collect()
    assert sorted((tuple(x[c] for c in CONTRACT) for x in got), key=str) == plain(rows)
