"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a 64-bit hash of the text. For each splitter between shards, exact bytes are counted below probe keys
(here: the edges of equal buckets of the interval in which the splitter lies), and the interval shrinks to one bucket
until the splitter meets the tolerance. Splitters known, rows are exchanged once.

Equal texts have one key, so they lie in one shard. Texts that with their copies weigh more than LARGE of a shard (fewer than shards / LARGE,
whatever the input) are dealt to shards first, heaviest first, each to the lightest shard; the splitters then deal the light texts so that
all shards come out level. Only a text whose copies outweigh a shard is divided, over as few shards as hold it, because sizes
near equal are the law. Shards differ by the tolerance and a light text, unless whole texts are so heavy that no dealing is level; then by
the heaviest text that is not divided.

Defined results: a null text has size 8 and the checksum of the empty text and lies with empty texts; an empty table gives an empty
result. Columns of the input that are carried live in a struct until the end, so no name can clash.
"""

from __future__ import annotations

import math
from heapq import heappop, heappush
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.columns import utf8_size
from siltworks.session import settle

SHARDS = 24
TOLERANCE = 0.0005
BITS = 12
OVERHEAD = 8
#: Share of a shard's bytes from which on a text and its copies are dealt to a shard by themselves.
LARGE = 0.002
#: Rows of a shard are numbered in groups of about so many bytes, of which a shard has at least the first number below and at most the second.
GROUP_BYTES = 1 << 27
GROUPS = (64, 8192)


def _unsigned(x: Column) -> Column:
    """Signed numbers in the order of the unsigned ones."""
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def splitters(rows: DataFrame, shares: list[float], tolerance: float = TOLERANCE) -> list[int]:
    """Keys, unsigned; a row belongs to the shard whose number is the count of splitters not above its key; shards get such shares of the bytes.

    The driver reads at most 2**BITS sums for each splitter that is not yet settled, whatever the input's size.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = len(shares)
    goals = [total * x for x in accumulate(shares)]
    slack = total / shards * tolerance
    found: list[int | None] = [None] * (shards - 1)
    todo = {i: (0, 0) for i in range(shards - 1)}  # interval as a prefix of the key, bytes below it
    depth = 0
    while todo and total:
        step = min(BITS, 64 - depth)
        prefixes = sorted({p for p, _ in todo.values()})
        which = F.lit(None).cast("int") if depth else F.lit(0)
        for n, p in enumerate(prefixes if depth else ()):
            which = F.when(F.shiftrightunsigned(F.col("key"), 64 - depth) == _signed(p), F.lit(n)).otherwise(which)
        bucket = F.shiftrightunsigned(F.col("key"), 64 - depth - step).bitwiseAND((1 << step) - 1)
        sums = rows.withColumn("which", which).where("which is not null").groupBy("which", bucket.alias("bucket")).agg(F.sum("size").alias("bytes"), (F.min("key") == F.max("key")).alias("one_key")).collect()
        whole = {(prefixes[r["which"]], r["bucket"]) for r in sums if r["one_key"]}
        buckets: dict[int, list] = {}
        for r in sorted(sums, key=lambda r: r["bucket"]):
            buckets.setdefault(prefixes[r["which"]], []).append((r["bucket"], r["bytes"]))
        left = {}
        for i, (prefix, below) in todo.items():
            goal = goals[i]
            for bucket, size in buckets[prefix]:
                if below + size >= goal or bucket == buckets[prefix][-1][0]:
                    break
                below += size
            low, high = below, below + size
            start = ((prefix << step) | bucket) << (64 - depth - step)
            if min(goal - low, high - goal) <= slack or (prefix, bucket) in whole or depth + step == 64:
                found[i] = start if goal - low <= high - goal else start + (1 << (64 - depth - step))
            else:
                left[i] = ((prefix << step) | bucket, below)
        todo, depth = left, depth + step
    return [1 << 64 if x is None else x for x in found]


def deal(pieces: list[tuple[int, int]], shards: int) -> tuple[list[int], list[int]]:
    """For each of (key, bytes) its shard, heaviest first to the lightest shard, and the shards' bytes."""
    loads = [(0, n) for n in range(shards)]
    where = [0] * len(pieces)
    for i in sorted(range(len(pieces)), key=lambda i: (-pieces[i][1], pieces[i][0], i)):
        load, n = heappop(loads)
        where[i] = n
        heappush(loads, (load + pieces[i][1], n))
    return where, [load for load, _ in sorted(loads, key=lambda x: x[1])]


def fill_level(loads: list[int], more: int) -> list[float]:
    """Shares of `more` that bring shards with these loads to one level, as far as it goes."""
    if not more:
        return [1 / len(loads)] * len(loads)
    rising, level = sorted(loads), 0.0
    for n in range(1, len(rising) + 1):
        level = (sum(rising[:n]) + more) / n
        if n == len(rising) or level <= rising[n]:
            break
    return [max(0.0, level - x) / more for x in loads]


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE, carry: list[str] | None = None) -> DataFrame:
    """size, text_crc32, shard, slot and the carried columns (all of docs unless named), with near-equal bytes in each shard."""
    names = docs.columns if carry is None else carry
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = settle(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
            (utf8_size(F.col(f"`{text_col}`")) + OVERHEAD).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
            F.xxhash64(F.col(f"`{id_col}`"), F.lit(5)).alias("order"),
            F.monotonically_increasing_id().alias("row_id"),
        )
    )
    mean = (rows.agg(F.sum("size")).first()[0] or 0) / shards
    # Fewer than shards / LARGE rows, whatever the input's size.
    heavy = rows.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > mean * LARGE)
    heavy = sorted((r["key"], r["bytes"]) for r in heavy.collect())
    parts = {key: min(shards, math.ceil(size / mean)) if size > mean else 1 for key, size in heavy}
    piece = lambda n: F.pmod(F.xxhash64("row_id"), n).cast("int")
    divided = [k for k in parts if parts[k] > 1]  # fewer than shards
    if divided:
        n = F.lit(1)
        for k in divided:
            n = F.when(F.col("key") == k, F.lit(parts[k])).otherwise(n)
        sums = rows.where(F.col("key").isin(divided)).groupBy("key", piece(n).alias("piece")).agg(F.sum("size").alias("bytes")).collect()
        pieces = sorted((r["key"], r["piece"], r["bytes"]) for r in sums) + [(k, 0, size) for k, size in heavy if parts[k] == 1]
    else:
        pieces = [(k, 0, size) for k, size in heavy]
    where, loads = deal([(k, size) for k, _, size in pieces], shards)
    homes = {k: [0] * n for k, n in parts.items()}
    for (k, p, _), shard in zip(pieces, where, strict=True):
        homes[k][p] = shard
    table = rows.sparkSession.createDataFrame([(k, x) for k, x in homes.items()], "heavy long, homes array<int>")
    rows = rows.join(F.broadcast(table), F.col("key") == F.col("heavy"), "left")
    light = rows.where("heavy is null")
    shard = F.lit(0)
    for key in splitters(light, fill_level(loads, light.agg(F.sum("size")).first()[0] or 0), tolerance) if shards > 1 else ():
        if not key >> 64:  # else a splitter above every key
            shard = shard + (_unsigned(F.col("key")) >= _signed(key ^ (1 << 63))).cast("int")
    home = F.get("homes", piece(F.size("homes")))
    groups = min(max(GROUPS[0], math.ceil(mean / GROUP_BYTES)), GROUPS[1])
    placed = rows.select("row", "size", "text_crc32", F.when(F.col("heavy").isNotNull(), home).otherwise(shard).alias("shard"), F.pmod(F.xxhash64("row_id", F.lit(1)), F.lit(groups)).alias("part"), "key", "order")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", before.alias("before"))  # shards x groups rows, so at most shards x 8,192
    order = Window.partitionBy("shard", "part").orderBy("key", "order")
    out = placed.join(F.broadcast(starts), ["shard", "part"]).withColumn("slot", (F.col("before") + F.row_number().over(order) - 1).cast("long"))
    return out.select("row.*", F.col("size"), F.col("text_crc32"), F.col("shard").cast("int").alias("shard"), "slot")
