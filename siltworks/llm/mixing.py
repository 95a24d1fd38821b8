"""Mixing sources to target weights with hash-threshold histograms.

Each source gets a budget of words. A document's place is a 64-bit hash of its id and text. For each source, words are
summed by hash bucket; the running sum shows in which bucket the budget ends, and only that bucket is split further, until it
holds few documents. Rows are then kept by comparing hashes with thresholds: nothing is sorted, and a smaller budget
always takes a subset of the rows that a larger one takes (but for the few documents of the last bucket).

Defined results: a null or empty text has size 0 and is never taken; null sources form one source, placed last; repeated rows
have one hash and are taken together or not at all, unless whole copies are due; an empty table gives an empty result.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltworks.llm.columns import n_words
from siltworks.session import settle

WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
CEILING = 2
BITS = 12
#: A boundary bucket with no more documents than this is settled document by document.
FEW = 64
SMALL_TABLE = 10_000


def fill_targets(sizes: list[int], weights: list[int], budget: Fraction, ceiling: int = CEILING) -> list[Fraction]:
    """Shares of budget by weight; a share over ceiling times its size stops there and its excess is shared again."""
    targets = [Fraction(0)] * len(sizes)
    active, left = list(range(len(sizes))), Fraction(budget)
    while active:
        unit = left / sum(weights[i] for i in active)
        over = [i for i in active if unit * weights[i] > ceiling * sizes[i]]
        for i in over or active:
            targets[i] = Fraction(ceiling * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        left -= sum(targets[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return targets


def _boundaries(rows: DataFrame, spark, plans: dict) -> dict:
    """For each source with a partial copy: (hash threshold, hashes taken beyond it)."""
    todo = {s: (0, 0, p) for s, (_, p) in plans.items() if p > 0}  # prefix, depth, words still to take
    done: dict = {}
    while todo:
        depth = next(iter(todo.values()))[1]
        table = spark.createDataFrame([(s, p) for s, (p, _, _) in todo.items()], "k string, prefix long")
        at = F.shiftrightunsigned(F.col("place"), 64 - depth) if depth else F.lit(0).cast("long")
        here = rows.join(F.broadcast(table) if len(todo) <= SMALL_TABLE else table, "k").where(at == F.col("prefix"))
        step = min(BITS, 64 - depth)
        bucket = F.shiftrightunsigned(F.col("place"), 64 - depth - step).bitwiseAND((1 << step) - 1)
        sums = here.groupBy("k", bucket.alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        sums = sums.withColumn("through", F.sum("words").over(Window.partitionBy("k").orderBy("bucket")))
        goal = spark.createDataFrame([(s, float(w)) for s, (_, _, w) in todo.items()], "k string, goal double")
        edge = sums.join(F.broadcast(goal) if len(todo) <= SMALL_TABLE else goal, "k")
        edge = edge.where((F.col("through") >= F.col("goal")) & (F.col("through") - F.col("words") < F.col("goal"))).select("k", F.col("bucket").alias("at"))
        # Around each boundary bucket: rows of the aligned runs of 2**j buckets that hold it, and words before each run.
        near = sums.join(F.broadcast(edge) if len(todo) <= SMALL_TABLE else edge, "k")
        same = [F.shiftright("bucket", j) == F.shiftright("at", j) for j in range(step + 1)]
        less = [F.shiftright("bucket", j) < F.shiftright("at", j) for j in range(step + 1)]
        runs = near.groupBy("k", "at").agg(F.array(*[F.sum(F.when(x, F.col("n")).otherwise(0)) for x in same]).alias("n"), F.array(*[F.sum(F.when(x, F.col("words")).otherwise(0)) for x in less]).alias("before"))
        found = {r["k"]: r for r in runs.collect()}
        small, deeper = {}, {}
        for s, (prefix, _, words) in todo.items():
            r = found.get(s)
            if r is None:  # the whole rest fits
                done[s] = ((prefix + 1) << (64 - depth), [])
                continue
            wide = max((j for j in range(step + 1) if r["n"][j] <= FEW), default=-1)
            if wide < 0 and depth + step < 64:
                deeper[s] = ((prefix << step) | r["at"], depth + step, words - r["before"][0])
                continue
            wide = max(wide, 0)
            first = ((prefix << (step - wide)) | (r["at"] >> wide)) << (64 - depth - step + wide)
            small[s] = (first, first + (1 << (64 - depth - step + wide)), words - r["before"][wide])
        todo = deeper
        done |= _last(rows, spark, small)
    return done


def _last(rows: DataFrame, spark, small: dict) -> dict:
    """Settles boundary runs by document: of their few groups of equal hashes, those that together come nearest to the rest of the budget."""
    if not small:
        return {}
    table = spark.createDataFrame([(s, _flipped(a), _flipped(b - 1)) for s, (a, b, _) in small.items()], "k string, low long, high long")
    flipped = F.col("place").bitwiseXOR(F.lit(-(1 << 63)))
    here = rows.join(F.broadcast(table) if len(small) <= SMALL_TABLE else table, "k").where(flipped.between(F.col("low"), F.col("high")))
    groups: dict = {}
    for r in here.groupBy("k", "place").agg(F.sum("size").alias("words")).collect():
        groups.setdefault(r["k"], []).append((r["place"] % (1 << 64), r["words"]))
    return {s: (first, nearest_subset(sorted(groups.get(s, [])), left)) for s, (first, _, left) in small.items()}


def nearest_subset(groups: list[tuple[int, int]], goal) -> list[int]:
    """Of (place, words), places whose words come nearest to the goal; sums are marked in the bits of a number.

    Sums beyond a million are told apart in steps of their millionth part.
    """
    unit = max(1, int(goal) >> 20)
    sizes = [(place, round(words / unit)) for place, words in groups if words]
    goal = float(goal) / unit
    mask = (1 << (2 * int(goal) + 2)) - 1  # beyond that, nothing at all is nearer
    reach = [1]
    for _, size in sizes:
        reach.append((reach[-1] | reach[-1] << size) & mask)
    below = reach[-1] & ((1 << (int(goal) + 1)) - 1)
    at = below.bit_length() - 1
    above = reach[-1] >> (int(goal) + 1)
    if above:
        over = int(goal) + (above & -above).bit_length()
        at = over if over - goal < goal - at else at
    chosen = []
    for (place, size), before in zip(reversed(sizes), reversed(reach[:-1]), strict=True):
        if not before >> at & 1:
            chosen.append(place)
            at -= size
    return chosen


def _flipped(x: int) -> int:
    """An unsigned number as the signed one of the same rank."""
    return _signed(x ^ (1 << 63))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share=SHARE, ceiling: int = CEILING, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies, taken, and the columns named in carry.

    The driver holds one number per source and per histogram bucket in which a source's budget ends, not documents.
    """
    spark = docs.sparkSession
    source = F.col(f"`{source_col}`").cast("string")
    key = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), key.alias("k"), n_words(F.col(f"`{text_col}`")).alias("size"), F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.lit(17)).alias("place"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried") if carry else F.lit(None).cast("string").alias("carried"))
    rows = settle(base)
    totals = {r["k"]: r["words"] for r in rows.groupBy("k").agg(F.sum("size").alias("words")).collect()}
    names = sorted(totals, key=lambda k: (k[0] == "n", k))
    goals = fill_targets([totals[k] for k in names], [weights[i % len(weights)] for i in range(len(names))], Fraction(share) * sum(totals.values()), ceiling)
    plans = {}
    for k, goal in zip(names, goals, strict=True):
        whole = min(int(goal / totals[k]), ceiling) if totals[k] else 0
        plans[k] = (whole, goal - whole * totals[k])
    edges = _boundaries(rows, spark, plans)
    table = []
    for k, goal in zip(names, goals, strict=True):
        edge, chosen = edges.get(k, (0, []))
        table.append((k, totals[k], float(goal), plans[k][0], edge >= 1 << 64, _flipped(edge % (1 << 64)), [_signed(c) for c in chosen]))
    table = spark.createDataFrame(table, "k string, source_size long, target double, whole int, everything boolean, edge long, chosen array<long>")
    # Unsigned comparison of hashes: flip the highest bit and compare as signed numbers.
    ahead = F.col("everything") | (F.col("place").bitwiseXOR(F.lit(-(1 << 63))) < F.col("edge")) | F.array_contains("chosen", F.col("place"))
    out = rows.join(F.broadcast(table) if len(names) <= SMALL_TABLE else table, "k").withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + ahead.cast("int")))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), *[F.col(f"carried.`{c}`").alias(c) for c in carry if c != "doc_id"])


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, in their own columns."""
    names = docs.columns
    packed = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole_row"))
    out = mix(packed, carry=("whole_row",), **options).where("copies > 0")
    return out.select("whole_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole_row.*")
