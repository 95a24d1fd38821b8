"""A trie of conversation prefixes, encoded as preorder intervals.

A conversation is a sequence of turns; each distinct sequence of first d turns is a node at depth d. Nodes are ranked lexicographically,
so the subtree of a node is an interval of ranks from its own to its subtree's end. Leaves and savings of subtrees are then differences of
running sums over the ranks, computed over ranges of the order.

A prefix is identified by two sums, over its turns, of 60-bit digests of (place, role, text): sums are running sums of a scan, so a conversation of
any length is spread over ranges and no task reads it whole. A node's place in the order is the list of the turns chosen where its path branches,
then its depth; stretches without branches cost nothing, so these lists grow with the branchings on a path, not with its length. The end
of a subtree is the greatest rank among the leaves whose conversations pass through the node.

Joins on prefixes or parents can meet one value in most rows (a common first turn). There the other side has one row for each value and a weight that
bounds its partners; the few values with at least 1 / HEAVY of all weight, HEAVY at most, are broadcast, and the others are exchanged.

Defined results: null roles and texts are empty; turns with equal or null numbers follow each other by role and text, nulls of numbers first; rows with a
null conversation id belong to no conversation; repeated rows are turns of their own; conversations without turns have the root alone; without
conversations there is no node; only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.operators.ranges import scan
from siltworks.session import settle, shuffle_width

#: Values with at least this part of all weight are broadcast; there are no more than as many.
HEAVY = 10_000
#: Bytes of joined ids in one row, about.
PIECE = 1 << 20
#: The last prefix length that a rebuilt conversation takes over from its base, and how many conversations share a base.
HEAD, FAMILY = 8, 5


def join_by_weight(many: DataFrame, one: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """many joined with one, which has one row for each value of key and a weight of at least as much as there are partners."""
    total = one.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HEAVY >= total
    few, rest = F.broadcast(one.where(heavy).drop(weight)), one.where(~heavy).drop(weight)
    if how == "inner":
        return many.join(few, key).unionByName(many.join(rest, key))
    return many.join(few, key).unionByName(many.join(few, key, "left_anti").join(rest, key, how))


def turns_in_order(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, nth (from 1), role, text."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.where(F.col(f"`{conv_col}`").isNotNull()).select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    return scan(rows, ["turn", "role", "text"], by=["conv_id"], sums={"nth": F.lit(1)}).drop("turn")


def taken_over(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the base of its family."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations that begin with the first turns of their family's base: conv_id, part, nth, role, text, with a row of part 0 for each conversation."""
    known = turns.select("conv_id").distinct()
    family = F.explode(F.transform(F.sequence(F.lit(0), F.lit(FAMILY - 1)), lambda i: F.try_add(F.col("conv_id"), i.cast("long"))))
    heads = turns.where((F.pmod("conv_id", F.lit(FAMILY)) == 0) & (F.col("nth") <= HEAD)).select(family.alias("conv_id"), F.lit(1).alias("part"), "nth", "role", "text")
    heads = heads.where(F.col("nth") <= taken_over(F.col("conv_id"))).join(known, "conv_id", "left_semi")
    own = turns.where(F.col("nth") > taken_over(F.col("conv_id"))).select("conv_id", F.lit(2).alias("part"), "nth", "role", "text")
    roots = known.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("nth"), F.lit("").alias("role"), F.lit("").alias("text"))
    return roots.unionByName(heads).unionByName(own)


def prefixes(rows: DataFrame) -> DataFrame:
    """One row for each prefix of each conversation: conv_id, depth, path, parent, step (the last turn's digest), size (its text's bytes)."""
    # The place in the digest is the row's depth, which is the first scan's result.
    placed = scan(rows, ["part", "nth"], by=["conv_id"], sums={"depth": F.lit(1)}).withColumn("depth", F.col("depth") - 1)
    said = F.concat_ws("\n", F.octet_length("role").cast("string"), F.col("role"), F.col("text"))
    placed = placed.select("conv_id", "depth", F.sha2(said.cast("binary"), 256).alias("turn"), F.octet_length("text").cast("long").alias("size"))
    number = lambda digits, at: F.conv(F.substring(digits, at, 15), 16, 10).cast("decimal(20,0)")
    there = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), F.col("turn")).cast("binary"), 256)
    placed = placed.withColumn("a", F.when(F.col("depth") > 0, number(there, 1)).otherwise(0)).withColumn("b", F.when(F.col("depth") > 0, number(there, 16)).otherwise(0))
    summed = scan(placed, ["depth"], by=["conv_id"], sums={"to_a": F.col("a"), "to_b": F.col("b")})
    name = lambda a, b: F.unhex(F.md5(F.concat_ws(":", a.cast("string"), b.cast("string")).cast("binary")))
    parent = F.when(F.col("depth") > 0, name((F.col("to_a") - F.col("a")).cast(summed.schema["to_a"].dataType), (F.col("to_b") - F.col("b")).cast(summed.schema["to_b"].dataType)))
    return summed.select("conv_id", "depth", name(F.col("to_a"), F.col("to_b")).alias("path"), parent.alias("parent"), F.unhex(F.substring("turn", 1, 32)).alias("step"), "size")


def _joined(most: int):
    """Rows (path, conv_id) in order become pieces (path, first id, joined ids) of bounded size."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, first, ids, size = None, 0, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])], ["path", "first", "ids"])

        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (p != path or size >= most):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    path, first = p, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield piece()

    return rows


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (path, first) become one digest for each path; SHA-256 reads its text in order, so one task reads a path's pieces, one by one."""
    path, digest, done = None, None, []
    for batch in batches:
        for p, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if p != path:
                if path is not None:
                    done.append((path, digest.hexdigest()))
                path, digest = p, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if len(done) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["path", "ends_sha256"])
            done = []
    if path is not None:
        done.append((path, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done])], ["path", "ends_sha256"])


def ends_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """path, ends_sha256 of the ascending ids (path, conv_id) joined by commas. A path with most ids covers several ranges of the first step."""
    width = shuffle_width(ends.sparkSession)
    pieces = ends.select("path", "conv_id").repartitionByRange(width, "path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(_joined(piece), "path binary, first long, ids string")
    return pieces.repartition(width, "path").sortWithinPartitions("path", "first").mapInArrow(_hashed, "path binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row per node of prefixes() rows: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, rank, subtree_end."""
    rows = settle(rows)
    nodes = rows.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("size").alias("size"))
    families = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_convs").alias("n_rows"))
    nodes = settle(nodes.join(families.select(F.col("parent").alias("path"), "n_children"), "path", "left").fillna(0, ["n_children"]))
    families = settle(families)

    # The turns chosen where paths branch, in order, of each conversation that stands for a node.
    branching = families.where("n_children > 1").select("parent", F.col("n_rows").alias("weight"))
    choices = join_by_weight(rows.select("conv_id", "depth", "parent", "step"), branching, "parent", "weight").select("conv_id", "depth", "step")
    choices = choices.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "step"))).alias("choices"))
    chosen = F.transform(F.filter(F.coalesce("choices", F.array().cast("array<struct<depth:bigint,step:binary>>")), lambda x: x["depth"] <= F.col("depth")), lambda x: x["step"])
    keyed = nodes.join(choices, "conv_id", "left").select("*", chosen.alias("order")).drop("choices")

    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("size")
    ranked = settle(scan(keyed, ["order", "depth"], sums={"rank": F.lit(1).cast("long"), "leaves": leaf, "savings": saved}).drop("order"))
    # Each subtree ends with a leaf; a leaf's conversation passes through all nodes above it.
    leaves = ranked.where("n_children = 0").select("conv_id", F.struct("rank", "leaves", "savings").alias("last"))
    last = rows.select("conv_id", "path").join(leaves, "conv_id").groupBy("path").agg(F.max("last").alias("last"))
    ends = rows.groupBy("conv_id").agg(F.max_by("path", "depth").alias("path"))
    whole = ranked.join(last, "path").join(ends_digests(ends), "path", "left")
    whole = whole.select(
        "conv_id",
        "depth",
        "parent",
        "n_convs",
        "n_children",
        (F.col("last.leaves") - F.col("leaves") + leaf).alias("n_leaves"),
        (F.col("last.savings") - F.col("savings") + saved).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        (F.col("rank") - 1).alias("place"),
        (F.col("last.rank") - 1).alias("subtree_end"),
    ).withColumnRenamed("place", "rank")
    parents = nodes.where("n_children > 0").select(F.col("path").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    return join_by_weight(whole, parents, "parent", "weight", "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "rank", "subtree_end")
