"""Document fingerprints by winnowing.

Letters and digits of a text (ASCII letters in lower case; code points from 128 on count as they are; ASCII white space and
punctuation do not count) form a sequence; every K of them get a rolling hash; of every WINDOW consecutive hashes the least is
chosen, the rightmost on ties. Chosen hashes keep the code-point position in the whole text at which their K-gram begins. Two
texts that share a run of K + WINDOW - 1 counted characters share at least one fingerprint, and any match is at least K long.

Likeness of two fingerprints is twice the number of hashes that they share (with repeats) over the number of hashes of both; two
empty fingerprints are alike 1, an empty and another 0.

Defined results: null texts are empty texts; a text with fewer than K counted characters has one hash, of all it has (a text with none:
of its own bytes, the empty text: none); rows follow each other by descending id (null ids last), equal ids by text; repeated
rows are documents of their own; a single row is its own successor; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.columns import edges_below
from siltworks.llm.words import mix64, sliding_min, stream
from siltworks.session import arrow_rows, settle, shuffle_width

#: Parts of the ids that are dealt out, at most.
PARTS = 8192
K = 12
WINDOW = 29
_RADIX = stream(7, 1)[0] | np.uint64(1)
_DROPPED = np.ones(128, bool)
_DROPPED[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(128, dtype=np.uint32)
_LOWER[65:91] += 32


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and their positions, in order of position."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = raw < 128
    folded = np.where(low, _LOWER[np.where(low, raw, 0)], raw)
    where = np.flatnonzero(~(low & _DROPPED[np.where(low, raw, 0)]))
    if not len(where):
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        folded, where = raw, np.zeros(1, np.int64)
        k = len(raw)
        x = raw.astype(np.uint64)
    else:
        x = folded[where].astype(np.uint64)
        k = min(k, len(x))
    # Hash of a K-gram: sum of its characters times powers of the radix, built by doubling from shorter runs.
    grams, have, power = mix64(x), 1, _RADIX
    result, used = None, 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            if result is None:
                result, used, shift = grams, have, power
            else:
                n = len(x) - (used + have) + 1
                result = result[:n] * power + grams[used : used + n]
                used += have
        if bit + 1 < k.bit_length():
            grams = grams[:-have] * power + grams[have:]
            power, have = np.uint64(int(power) ** 2 % (1 << 64)), have * 2
    hashes = mix64(result) >> np.uint64(32)
    # The least (hash, -position): of equal hashes the rightmost is the least.
    ranked = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64))
    least = sliding_min(ranked, min(window, len(ranked)))
    chosen = least[np.append(True, least[1:] != least[:-1])]
    return (chosen >> np.uint64(32)).astype(np.uint32), where[(np.uint64(0xFFFFFFFF) - (chosen & np.uint64(0xFFFFFFFF))).astype(np.int64)].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return 2.0 * int(np.minimum(n[i], m[j]).sum()) / (len(a) + len(b))


def as_text(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits for each hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


FINGERPRINTS = "doc_id long, hashes array<long>, positions array<long>"


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [winnow(t or "") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p.astype(np.int64) for _, p in found], pa.list_(pa.int64()))], ["doc_id", "hashes", "positions"])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, chosen hashes and their positions."""
    arrow_rows(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_fingerprints, FINGERPRINTS)


CHAIN = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part and descending id; each part ends with a guest, the first row of the next part."""
    names = [x.split()[0] for x in CHAIN.split(", ")]
    before = None
    for batch in batches:
        out = []
        for part, guest, doc_id, text in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            hashes = winnow(text)[0]
            if before is not None and before[0] == part:
                _, own_id, own, own_hashes = before
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                edited_hashes = winnow(edited)[0]
                out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own_hashes), as_text(edited_hashes), likeness(own_hashes, edited_hashes), likeness(own_hashes, hashes)))
            before = None if guest else (part, doc_id, text, hashes)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)], names)


def compare_with_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document its fingerprint, that of the text edited with its successor's beginning, and how alike they are.

    Ids are cut into parts of about equal row counts, and each part also gets a copy of the row that follows its last one; so one
    exchange of texts is enough, and no task sees more than a part. A part's rows stream through, one at a time.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    base = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("rank"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parts = min(4 * shuffle_width(spark), PARTS)
    edges = base.agg(F.percentile_approx("rank", [i / parts for i in range(1, parts)], 4 * parts)).first()[0]  # bounds of parts, nothing else
    edges = sorted(set(edges or []))
    # Part 0 has the largest ids; a part's number counts the edges that are not below the row's rank.
    part = len(edges) - edges_below(edges, F.col("rank"))
    base = base.withColumn("part", part)
    tops = base.groupBy("part").agg(F.max("rank").alias("rank")).collect()  # one number per part
    order = sorted(r["part"] for r in tops)
    table = spark.createDataFrame([(r["part"], r["rank"], order[order.index(r["part"]) - 1]) for r in tops], "top_part int, top long, host int") if tops else spark.createDataFrame([], "top_part int, top long, host int")
    guests = base.join(F.broadcast(table), (F.col("part") == F.col("top_part")) & (F.col("rank") == F.col("top")))
    guests = settle(guests.groupBy("host").agg(F.min(F.struct("rank", "text", "doc_id")).alias("first")))
    guests = guests.select(F.col("host").alias("part"), F.lit(True).alias("guest"), "first.doc_id", "first.text", "first.rank")
    rows = base.select("part", F.lit(False).alias("guest"), "doc_id", "text", "rank").unionByName(guests)
    rows = rows.repartition(shuffle_width(spark), "part").sortWithinPartitions("part", "guest", F.desc("rank"), "text")
    return rows.select("part", "guest", "doc_id", "text").mapInArrow(_chain, CHAIN)
