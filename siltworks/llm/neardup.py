"""Near-duplicate detection with SetSketch registers.

A document is the set of its distinct 5-word shingles (words lower-cased in A-Z; fewer words: the whole sequence as one shingle).
Documents with equal sets (by a 128-bit digest) form a class, and one sketch stands for a class. A sketch has REGISTERS registers: each holds the
minimum of an exponential variable over the set, truncated to the scale base**-k, so that sketches of parts merge by maximum and the
chance of equal registers follows the similarity. Bands of four registers (fewer at thresholds far below 75 percent) are keys; classes that share
a key are candidates. Candidates are compared by the likelihood of their registers' order relations, given the exact set sizes; those that
may reach the threshold are verified on full sets. Linked classes form components.

1. Hubs. Each class is compared with one class of each of its buckets, the hub, which is the least in a random order, so that buckets
   of one family agree on it. Rows grow with the buckets' members, never with their pairs. Large buckets have hubs of their parts,
   which meet the bucket's, and are given other hubs while that still joins components.
2. The rest. Buckets whose members still lie in several components are compared exhaustively inside tasks: members of the bucket's
   largest component stay in blocks of bounded size, all others visit every block. A pair is looked at in the first band that it
   shares, verified there on full sets, and only links that join two components leave the task.

Defined results: null or empty texts have no shingles and link with nothing; null ids count as the largest id and come back as null;
repeated rows are documents of their own with equal sets; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.columns import WORD
from siltworks.llm.graph import components
from siltworks.llm.words import hash_words, mix64, stream, window_hashes
from siltworks.session import arrow_rows, settle, tidy

SHINGLE = 5
REGISTERS, BAND, BANDS = 256, 4, 32
#: Of the sketch: base of the scale, rate of the exponential variables, largest register.
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
PERCENT = 75
#: At PERCENT: candidates whose likeliest similarity is below this are not verified: over five standard deviations under the threshold; the share of
#: equal registers of a likely pair is above EQUAL.
ESTIMATE, EQUAL = 0.60, 0.55
#: Classes and shingles of one block of a bucket, about; parts in which hubs of large buckets are chosen, and the size from which on they are.
BLOCK, BLOCK_SHINGLES, PARTS, LARGE = 2048, 1 << 22, 64, 4096
#: Hubs of large buckets are chosen anew while this share of the compared pairs are links.
WORTH = 0.02
LAST = (1 << 63) - 1

_FACTORS = stream(21, REGISTERS) | np.uint64(1)
_BANDS = stream(22, REGISTERS)


class Limits(NamedTuple):
    """What follows from the threshold: the limits of estimates, and registers a band and bands."""

    percent: int
    estimate: float
    equal: float
    band: int
    bands: int


def limits(percent: int) -> Limits:
    """Limits as many standard deviations from the threshold, and bands that miss no more, than at PERCENT."""
    base = PERCENT / 100
    deviation = lambda x: math.sqrt(x * (1 - x) / (base * (1 - base)))
    low = min(percent / 100, base)  # what keeps pairs at PERCENT keeps those above
    estimate, equal = (max(0.0, low - (base - x) * deviation(low)) if 0 < low else 0.0 for x in (ESTIMATE, EQUAL))
    if low == base:
        return Limits(percent, estimate, equal, BAND, BANDS)
    for band in (BAND, 2, 1):
        bands = math.ceil(BANDS * math.log1p(-(base**BAND)) / math.log1p(-(low**band))) if low > 0 else REGISTERS + 1
        if bands * band <= REGISTERS:
            return Limits(percent, estimate, equal, band, bands)
    raise ValueError(f"{REGISTERS} registers do not find pairs at {percent} percent")


def shingles(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = hash_words(text.lower())
    if not len(words):
        return words
    return np.unique(window_hashes(words, SHINGLE, 23) if len(words) >= SHINGLE else mix64(window_hashes(words, len(words), 24)))


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes; the sketch of a union is the greater of both in each register."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 64):
        np.minimum(least, (hashes[i : i + 64, None] * _FACTORS).min(axis=0), out=least)
    x = -np.log1p(-np.minimum(least / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP).astype("<u2")


def band_keys(sketch: np.ndarray, band: int = BAND, bands: int = BANDS) -> np.ndarray:
    return mix64(np.ascontiguousarray(sketch[: bands * band]).view(f"<u{2 * band}").astype("<u8") ^ _BANDS[:bands]).view(np.int64)


SIGNATURES = "rank long, text_hash long, n_shingles long, digest binary, keys array<long>"


def _signatures(to: Limits):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, keys = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingles(text or b"")
                n.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                keys.append(band_keys(registers(found), to.band, to.bands) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], [x.split()[0] for x in SIGNATURES.split(", ")])

    return rows


def _shelved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(text) for text in batch.column(1).cast(pa.binary()).to_pylist()]
        sketches = [registers(x).tobytes() for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sketches, pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["class", "sketch", "shingles"])


def likeliest(more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The similarity that maximises the likelihood of so many registers being greater and less, sets having n and m elements."""
    u, v = n / (n + m), m / (n + m)
    equal = REGISTERS - more - less
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j):
        p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE)
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(np.maximum(a, tiny)) + less * np.log(np.maximum(b, tiny)) + equal * np.log(np.maximum(1 - a - b, tiny))

    for _ in range(20):  # the likelihood is concave: ternary search, to a third of a thousandth
        third = (high - low) / 3
        left = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _common(p: np.ndarray, q: np.ndarray) -> int:
    """Entries that two sorted sets share."""
    if len(p) < len(q):
        p, q = q, p
    return int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum())


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    both = _common(p, q)
    return 100 * both >= percent * (len(p) + len(q) - both)


def _may_link(n, m, percent: int):
    """Sets of such sizes can reach the threshold."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _verified(to: Limits):
    """Of pairs (root, sketch and set of both) the roots of those that are links: by the estimate first, then on full sets."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (2, 4))
            sets = [[np.frombuffer(x, "<u8") for x in batch.column(i).to_pylist()] for i in (3, 5)]
            n, m = (np.array([len(x) for x in side], float) for side in sets)
            near = likeliest((a > b).sum(1), (a < b).sum(1), n, m) >= to.estimate
            linked = [bool(e) and _linked(p, q, to.percent) for e, p, q in zip(near, *sets, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return rows


def _likely(sketches: np.ndarray, n: np.ndarray, roots: np.ndarray, guests: np.ndarray, own: np.ndarray, band: int, to: Limits) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of a guest and a class of the block in different components that may be links and share no band before this one, with their
    likeliest similarity; a few guests at a time."""
    others = sketches[own][None, :, :]
    for i in range(0, len(guests), 32):
        left = guests[i : i + 32]
        equal = np.add.reduce((sketches[left][:, None, :] == others).view(np.uint8), axis=2, dtype=np.uint16)
        size = 100 * np.minimum(n[left][:, None], n[own]) >= to.percent * np.maximum(n[left][:, None], n[own])
        x, y = np.nonzero((equal >= to.equal * REGISTERS) & size & (roots[left][:, None] != roots[own]))
        a, b = left[x], own[y]
        if band and len(a):
            width = band * to.band
            earlier = (sketches[a, :width] == sketches[b, :width]).reshape(len(a), band, to.band).all(2).any(1)
            a, b = a[~earlier], b[~earlier]
        if len(a):
            j = likeliest((sketches[a] > sketches[b]).sum(1), (sketches[a] < sketches[b]).sum(1), n[a].astype(float), n[b].astype(float))
            near = j >= to.estimate
            yield a[near], b[near], j[near]


def _block_links(block: pd.DataFrame, to: Limits) -> pd.DataFrame:
    """Of one block of a bucket: pairs of roots that a link joins, as a spanning forest."""
    sketches = np.frombuffer(b"".join(block["sketch"]), "<u2").reshape(-1, REGISTERS)
    sets = [np.frombuffer(x, "<u8") for x in block["shingles"]]
    n, guest, home = np.array([len(x) for x in sets]), block["guest"].to_numpy(), block["home"].to_numpy()
    names, roots = np.unique(block["root"].to_numpy(), return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for a, b, j in _likely(sketches, n, roots, np.flatnonzero(guest), np.flatnonzero(home), int(block["band"].iloc[0]), to):
        order = np.argsort(-j, kind="stable")
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            p, q = find(int(roots[x])), find(int(roots[y]))
            if p != q and _linked(sets[x], sets[y], to.percent):
                parent[max(p, q)] = min(p, q)
                links.append((names[roots[x]], names[roots[y]]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _with_roots(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("class"))
    return members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def _apart(members: DataFrame) -> DataFrame:
    """Buckets (key) whose members lie in several components."""
    return members.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p < q").select("key")


def _hub_pairs(members: DataFrame, number: int, least: int, to: Limits) -> DataFrame:
    """a, b, their roots: each class and its bucket's hub. Large buckets choose a hub in each of PARTS parts, and these meet the bucket's.
    Only buckets of more than `least` classes in several components are looked at."""
    part = F.pmod(F.xxhash64("class"), F.lit(PARTS)).cast("int")
    own = F.struct(F.xxhash64("class", F.lit(number)).alias("order"), "class", "root", "n")
    parts = members.groupBy("key", part.alias("part")).agg(F.min(own).alias("own"), F.count("*").alias("c"), F.min("root").alias("p"), F.max("root").alias("q"))
    whole = parts.groupBy("key").agg(F.min("own").alias("all"), F.sum("c").alias("size"), F.min("p").alias("p"), F.max("q").alias("q")).where((F.col("p") < F.col("q")) & (F.col("size") > least)).select("key", "all", "size")
    parts = parts.select("key", "part", "own").join(whole, "key")
    hub = F.when(F.col("size") > LARGE, F.col("own")).otherwise(F.col("all"))
    spokes = members.withColumn("part", part).join(parts.select("key", "part", hub.alias("hub")), ["key", "part"]).select("hub", F.struct("class", "root", "n").alias("x"))
    between = parts.where(F.col("size") > LARGE).select(F.col("all").alias("hub"), F.struct("own.class", "own.root", "own.n").alias("x"))
    pairs = spokes.unionByName(between).where((F.col("hub.root") != F.col("x.root")) & _may_link(F.col("hub.n"), F.col("x.n"), to.percent))
    return pairs.select(F.col("hub.class").alias("a"), F.col("x.class").alias("b"), F.col("hub.root").alias("a_root"), F.col("x.root").alias("b_root")).distinct()


def _compared(pairs: DataFrame, shelf: DataFrame, to: Limits) -> DataFrame:
    """Roots (a, b) that links among pairs join."""
    side = lambda x: shelf.select(F.col("class").alias(x), F.col("sketch").alias(f"{x}_sketch"), F.col("shingles").alias(f"{x}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a_root", "b_root", "a_sketch", "a_set", "b_sketch", "b_set")
    return both.mapInArrow(_verified(to), "a long, b long").distinct()


def _rest(members: DataFrame, shelf: DataFrame, to: Limits) -> DataFrame:
    """Roots (a, b) that links join in buckets whose members lie in several components."""
    counts = members.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
    most = F.max(F.struct("c", "root"))["root"].alias("main")
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES)).cast("int")
    buckets = counts.groupBy("key").agg(most, F.count("*").alias("roots"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.max(F.struct("c", "root", "s")).alias("x")).where("roots > 1")
    buckets = buckets.select("key", "main", blocks(F.col("c"), F.col("s")).alias("blocks"), blocks(F.col("c") - F.col("x.c"), F.col("s") - F.col("x.s")).alias("companies"))
    rows = members.join(buckets, "key")
    block, company = F.pmod(F.xxhash64("class", F.lit(1)), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("class", F.lit(2)), F.col("companies")).cast("int")
    # Every class stands in its block for each company of guests; a class outside the largest component visits every block with its company.
    rows = rows.select("key", "band", "class", "root", (F.col("root") != F.col("main")).alias("outside"), "blocks", "companies", block.alias("block"), company.alias("company"))
    meets = F.explode(F.sequence(F.lit(0), F.col("companies") - 1)).alias("meets")
    own = rows.select("key", "band", "class", "root", "block", meets, F.lit(True).alias("home"), "outside", "company").withColumn("guest", F.col("outside") & (F.col("meets") == F.col("company")))
    visited = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block"))).alias("block")
    guests = rows.where("outside and blocks > 1").select("key", "band", "class", "root", visited, F.col("company").alias("meets"), F.lit(False).alias("home"), F.lit(True).alias("guest"))
    dealt = own.select(guests.columns).unionByName(guests).join(shelf, "class")
    return dealt.groupBy("key", "block", "meets").applyInPandas(lambda block: _block_links(block, to), "a long, b long").distinct()


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root after links between roots."""
    new = components(links)
    if roots is None:
        return settle(new)
    moved = roots.join(new.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return settle(moved.unionByName(new.join(roots.select("node"), "node", "left_anti")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id, kept, root (one number per component; null without shingles)."""
    to = limits(percent)
    arrow_rows(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    marks = settle(base.mapInArrow(_signatures(to), SIGNATURES))
    one = F.struct("rank", "text_hash", F.col("n_shingles").alias("n"), "keys")
    classes = marks.where("n_shingles > 0").groupBy("digest").agg(F.min(one).alias("x"))
    classes = settle(classes.select("digest", "x.*", F.monotonically_increasing_id().alias("class")))
    bands = classes.select("class", "n", F.posexplode("keys").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    members = settle(bands.join(shared, "key"))
    wanted = classes.join(members.select("class").distinct(), "class").select("class", "rank", "text_hash")
    texts = base.join(wanted, ["rank", "text_hash"]).groupBy("class").agg(F.min("text").alias("text"))
    shelf = settle(texts.mapInArrow(_shelved, "class long, sketch binary, shingles binary"))
    tidy(docs.sparkSession)

    links = settle(_compared(_hub_pairs(_with_roots(members, None), 0, 1, to), shelf, to))
    roots, number = _merged(None, links), 1
    tidy(docs.sparkSession)
    while True:  # parts of a large bucket may still lie apart
        pairs = settle(_hub_pairs(_with_roots(members, roots), number, LARGE, to))
        n = pairs.count()
        if not n:
            break
        links = settle(_compared(pairs, shelf, to))
        found, number = links.count(), number + 1
        if found:
            roots = _merged(roots, links)
        if found <= WORTH * n:
            break
    placed = _with_roots(members, roots)
    placed = settle(placed.join(_apart(placed), "key"))
    tidy(docs.sparkSession)
    links = settle(_rest(placed, shelf, to))
    tidy(docs.sparkSession)
    if links.limit(1).count():
        roots = _merged(roots, links)
    named = classes.select("digest", "class", "rank")
    named = _with_roots(named, roots)
    least = named.groupBy("root").agg(F.min("rank").alias("least"))
    named = named.join(least, "root").select("digest", "root", "least")
    out = marks.select("rank", "text_hash", "n_shingles", "digest").join(named, "digest", "left")
    least = F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("rank"))
    back = lambda c: F.when(c != LAST, c)
    return out.select(back(F.col("rank")).alias("doc_id"), "text_hash", "n_shingles", back(least).alias("component_id"), (F.col("rank") == least).alias("kept"), "root")


def one_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the least id stays (of equal ids the one with the least text
    hash, once); rows without shingles all stay."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent)
    rank = F.coalesce("doc_id", F.lit(LAST))
    stay = found.where("root is not null").groupBy("root").agg(F.min(F.struct(rank.alias("rank"), "text_hash")).alias("x")).select("x.rank", "x.text_hash")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("rank"), F.xxhash64(text).alias("text_hash"), text.rlike(WORD).alias("some"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    linked = rows.where("some").join(stay, ["rank", "text_hash"]).dropDuplicates(["rank", "text_hash"]).select("row.*")
    return linked.unionByName(rows.where(~F.coalesce(F.col("some"), F.lit(False))).select("row.*"))
