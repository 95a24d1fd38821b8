"""Substring deduplication with prefix-partitioned suffix trees.

A window is WINDOW consecutive words of a document. A window is redundant if the same words start in a document with a smaller id. A
redundant window's words are removed from its document.

1. Suffixes that can be shared. Of the hashes of GRAM consecutive words, each window of words is sure to hold the least one of its own
   (winnowing), so equal windows hold equal anchors. Anchors found in one document only are dropped; suffixes that start
   a window with a shared anchor are the ones that trees are built of. Nothing that is shared is lost.
2. Prefixes. A suffix is read as symbols of SYMBOL words, each a 64-bit hash. Suffixes are counted by the first bits of their first
   symbols; a prefix with too many is lengthened, by as many bits as its count asks for, and neighbouring small ones are taken together,
   so each group fits in memory. The driver holds two numbers for each counted prefix, at most 2 ** MOST_BITS.
3. Subtrees. Each group's suffixes are sorted, and the lengths of common prefixes of neighbours (in symbols) give the tree's internal
   nodes. Nodes of depth WINDOW words or more are the repeats; all their leaves but those of the least document are redundant.
   The same is done before the exchange within each task, where all but the least document's leaves of a node are settled at once, so
   that a passage that countless documents share arrives as one leaf per task.

Exact copies of a text are settled by two 64-bit hashes of the text with different seeds and do not enter the trees.

Defined results: null and empty texts have no words; null ids count as the largest id and come back as null; rows with equal
ids do not make each other's windows redundant; texts shorter than a window stay whole; an empty table gives an empty result; carried columns
live in a struct, so names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.words import hash_words, sliding_min, window_hashes
from siltworks.session import arrow_rows, settle, shuffle_width, tidy

WINDOW = 50
SYMBOL = 25
GRAM = 8
#: Suffixes of one subtree group, and of one task's own tree before the exchange, about.
GROUP = 250_000
#: Bits by which a prefix is told apart beyond those that number the groups: 8 prefixes for each group, about.
FINER = 3
#: Bits of the prefixes that are counted; longer prefixes follow from the counts.
MOST_BITS = 20
LAST = (1 << 63) - 1


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the anchors of a text and the words at which they start."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams = window_hashes(words, GRAM, 31)
    # 40 bits of hash, then the place counted from the end, so that the rightmost of equal hashes is the least.
    ranked = (grams >> np.uint64(24) << np.uint64(24)) | (np.uint64(0xFFFFFF) - (np.arange(len(grams), dtype=np.uint64) & np.uint64(0xFFFFFF)))
    least = sliding_min(ranked, WINDOW - GRAM + 1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    low = (np.uint64(0xFFFFFF) - (least[first] & np.uint64(0xFFFFFF))).astype(np.int64)
    at = first + ((low - first) & 0xFFFFFF)
    return grams[at], at


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, hashes, places = [], [], []
        for text in batch.column(2).cast(pa.binary()).to_pylist():
            words = hash_words(text or b"")
            h, at = anchors(words)
            n.append(len(words))
            hashes.append(h.view(np.int64))
            places.append(at)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(n, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int64()))], ["rank", "text_hash", "check", "n_words", "hashes", "places"])


def candidate_starts(n_words: int, places: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at places."""
    count = n_words - WINDOW + 1
    edge = np.zeros(count + 1, np.int64)
    np.add.at(edge, np.clip(places + GRAM - WINDOW, 0, count), 1)
    np.add.at(edge, np.clip(places + 1, 0, count), -1)
    return np.flatnonzero(np.cumsum(edge[:-1]) > 0)


def symbols(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The first WINDOW // SYMBOL symbols of the suffixes at starts, one row per depth."""
    h = window_hashes(words, SYMBOL, 32)
    return np.stack([h[starts + d] for d in range(0, WINDOW, SYMBOL)])


def subtree(suffixes: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Redundant leaves, and those still worth comparing: the least document's leaves of each node and single leaves.

    Leaves are sorted; a neighbour's common prefix in symbols tells where deep nodes begin and end.
    """
    order = np.lexsort((rank, *suffixes[::-1]))
    s, r = suffixes[:, order], rank[order]
    common = np.zeros(len(order), np.int64)
    alike = np.ones(max(0, len(order) - 1), bool)
    for depth in range(len(s)):
        alike &= s[depth, 1:] == s[depth, :-1]
        common[1:] += alike
    begins = np.flatnonzero(common < len(s))
    node_least = np.repeat(r[begins], np.diff(np.append(begins, len(order))))
    redundant = r > node_least
    return order[redundant], order[~redundant]


class Prefixes:
    """Variable-length prefixes of suffixes. The first bits of the first symbol number a group; neighbouring prefixes with few suffixes share one, and a
    crowded prefix is lengthened by as many bits as its count asks for. Two numbers for each counted prefix, 2 ** MOST_BITS at most, whatever the input."""

    def __init__(self, bits: int, counts: dict[int, int], group: int):
        self.bits = bits
        self.start = np.zeros(1 << bits, np.int64)
        self.longer = np.zeros(1 << bits, np.uint8)
        number, filled = 0, 0
        for prefix in range(1 << bits):
            n = counts.get(prefix, 0)
            if filled and filled + n > group:
                number, filled = number + 1, 0
            self.start[prefix] = number
            if n > group:
                self.longer[prefix] = (-(-n // group) - 1).bit_length()
                number, filled = number + (1 << int(self.longer[prefix])), 0
            else:
                filled += n
        self.groups = number + 1

    def of(self, suffixes: np.ndarray) -> np.ndarray:
        first = first_bits(suffixes, self.bits)
        longer = self.longer[first].astype(np.uint64)
        # Shifted in two steps, as no number can be shifted by all its 64 bits.
        return self.start[first] + (further(suffixes) >> np.uint64(1) >> (np.uint64(63) - longer)).astype(np.int64)


def first_bits(suffixes: np.ndarray, bits: int) -> np.ndarray:
    return (suffixes[0] >> np.uint64(1) >> np.uint64(63 - bits)).astype(np.int64)


def further(suffixes: np.ndarray) -> np.ndarray:
    """The bits by which a prefix is lengthened: all symbols mixed, so equal suffixes stay together and a common first symbol does not crowd a group."""
    mixed = np.zeros(suffixes.shape[1], np.uint64)
    for symbol in suffixes:
        mixed = (mixed ^ symbol) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed * np.uint64(0xBF58476D1CE4E5B9)


def _suffixes(batches: Iterator[pa.RecordBatch]):
    """For each candidate text: rank, text hash, starts, symbols."""
    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        for rank, text_hash, text, places in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2].cast(pa.binary()).to_pylist(), columns[3].to_pylist(), strict=True):
            words = hash_words(text)
            starts = candidate_starts(len(words), np.asarray(places, np.int64))
            if len(starts):
                yield rank, text_hash, starts, symbols(words, starts)


def _counted(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for _, _, _, s in _suffixes(batches):
            np.add.at(counts, first_bits(s, bits), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["prefix", "n"])

    return rows


#: Leaves travel as records of a suffix's symbols and its document and place; redundant windows as document and place.
_PLACE = [("rank", "<i8"), ("text_hash", "<i8"), ("start", "<i4")]
_LEAF = np.dtype([("symbols", "<u8", (WINDOW // SYMBOL,)), *_PLACE])
_MARK = np.dtype(_PLACE)
ROWS = "group long, leaves binary, home int, marks binary"


def _homes(marks: np.ndarray, homes: int) -> np.ndarray:
    return ((marks["rank"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % homes


def _by(values: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, bytes]]:
    if not len(values):
        return
    order = np.argsort(values, kind="stable")
    v = values[order]
    cuts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    for a, b in zip(cuts, [*cuts[1:], len(v)], strict=True):
        yield int(v[a]), rows[order[a:b]].tobytes()


def _settled(leaves: np.ndarray, homes: int) -> tuple[np.ndarray, list[tuple[int, bytes]]]:
    """Leaves that are not redundant among these, and the others as marks by home."""
    redundant, rest = subtree(np.ascontiguousarray(leaves["symbols"].T), leaves["rank"])
    marks = leaves[redundant]
    out = np.empty(len(marks), _MARK)
    for name in _MARK.names:
        out[name] = marks[name]
    return leaves[rest], list(_by(_homes(out, homes), out))


def _planted(prefixes: Prefixes, homes: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def flush():
            rest, marks = _settled(np.concatenate(held), homes)
            held.clear()
            groups = list(_by(prefixes.of(np.ascontiguousarray(rest["symbols"].T)), rest))
            # Marks that are settled already ride along with any group.
            table = [(g, x, None, None) for g, x in groups] + [(h % prefixes.groups, None, h, x) for h, x in marks]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*table, strict=True), [pa.int64(), pa.binary(), pa.int32(), pa.binary()], strict=True)], ["group", "leaves", "home", "marks"])

        for rank, text_hash, starts, s in _suffixes(batches):
            leaf = np.empty(len(starts), _LEAF)
            leaf["symbols"], leaf["rank"], leaf["text_hash"], leaf["start"] = s.T, rank, text_hash, starts
            held.append(leaf)
            n += len(leaf)
            if n >= GROUP:
                yield flush()
                n = 0
        if held:
            yield flush()

    return rows


def _grown(homes: int):
    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(h, m) for h, m in zip(rows["home"], rows["marks"], strict=True) if m is not None]
        leaves = [np.frombuffer(x, _LEAF) for x in rows["leaves"] if x is not None]
        if leaves:
            out += _settled(np.concatenate(leaves), homes)[1]
        return pd.DataFrame({"home": [int(h) for h, _ in out], "marks": [m for _, m in out]})

    return tree


def _gathered(rows: pd.DataFrame) -> pd.DataFrame:
    """The marks of a home by document: starts of its redundant windows."""
    marks = np.concatenate([np.frombuffer(x, _MARK) for x in rows["marks"]])
    marks = marks[np.lexsort((marks["start"], marks["text_hash"], marks["rank"]))]
    cuts = np.flatnonzero(np.append(True, (marks["rank"][1:] != marks["rank"][:-1]) | (marks["text_hash"][1:] != marks["text_hash"][:-1])))
    starts = [marks["start"][a:b].astype("<i4").tobytes() for a, b in zip(cuts, [*cuts[1:], len(marks)], strict=True)]
    return pd.DataFrame({"rank": marks["rank"][cuts], "text_hash": marks["text_hash"][cuts], "starts": starts, "copy": False})


def _without(texts: Iterator[tuple[bytes, bytes | None, bool]]) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    for text, starts, copy in texts:
        words = text.split()
        gone = np.zeros(len(words) + 1, np.int64)
        if copy and len(words) >= WINDOW:
            gone[0] = 1
        elif starts is not None:
            at = np.frombuffer(starts, "<i4")
            np.add.at(gone, at, 1)
            np.add.at(gone, at + WINDOW, -1)
        yield words, np.cumsum(gone[:-1]) > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "text", "n_words", "n_removed", "kept_sha256", "removed"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        out = []
        for text, (words, gone) in zip(texts, _without(zip((t or b"" for t in texts), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), strict=True):
            n = int(gone.sum())
            kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if n else b" ".join(words)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            out.append((kept if n else text, len(words), n, hashlib.sha256(kept).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.binary()).cast(pa.string()), *[pa.array(c, k) for c, k in zip(columns[1:], [pa.int64(), pa.int64(), pa.string(), span], strict=True)]], names)


def redundant_windows(base: DataFrame) -> DataFrame:
    """rank, text_hash, starts (little-endian 32-bit numbers), copy: for each document with redundant windows; copies of a whole text of a
    smaller id have copy set and no starts. base has rank, text_hash, text and check, a second hash of the text: copies agree in both."""
    spark = base.sparkSession
    marks = settle(base.mapInArrow(_anchored, "rank long, text_hash long, check long, n_words long, hashes array<long>, places array<long>").where(f"n_words >= {WINDOW}"))
    first = marks.groupBy("text_hash", "check").agg(F.min("rank").alias("least"), F.max("rank").alias("most"), F.min(F.struct("rank", "hashes", "places")).alias("x"))
    several = first.where("most > least").select("text_hash", "check", "least")
    copies = marks.select("rank", "text_hash", "check").join(several, ["text_hash", "check"]).where("rank > least")
    copies = copies.select("rank", "text_hash", F.lit(None).cast("binary").alias("starts"), F.lit(True).alias("copy")).distinct()
    copies = settle(copies)  # the trees below need nothing of what these were made from
    each = first.select("text_hash", F.col("least").alias("rank"), F.explode(F.arrays_zip(F.col("x.hashes").alias("hash"), F.col("x.places").alias("place"))).alias("a"))
    each = settle(each.select("rank", "text_hash", F.col("a.hash").alias("hash"), F.col("a.place").alias("place")))
    shared = each.groupBy("hash").agg(F.min("rank").alias("least"), F.max("rank").alias("most")).where("least < most").select("hash")
    shared = settle(shared)  # so that both sides of the join are exchanged anew and a frequent anchor's rows can be split
    hits = each.join(shared, "hash").groupBy("rank", "text_hash").agg(F.collect_list("place").alias("places"))
    candidates = settle(base.join(hits, ["rank", "text_hash"]).dropDuplicates(["rank", "text_hash"]).select("rank", "text_hash", "text", "places"))
    del marks, first, several, each, shared, hits
    tidy(spark)

    # Anchors are half a winnowing window apart on average, and each of the words between them starts a suffix.
    about = (candidates.agg(F.sum(F.size("places"))).first()[0] or 0) * (WINDOW - GRAM + 1) // 2
    bits = min(MOST_BITS, FINER + (about // GROUP).bit_length())
    counts = candidates.mapInArrow(_counted(bits), "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    prefixes = Prefixes(bits, {r["prefix"]: r["n"] for r in counts.collect()}, GROUP)
    homes = max(1, 2 * shuffle_width(spark), prefixes.groups)
    leaves = candidates.mapInArrow(_planted(prefixes, homes), ROWS)
    found = leaves.groupBy("group").applyInPandas(_grown(homes), "home int, marks binary")
    found = found.groupBy("home").applyInPandas(_gathered, "rank long, text_hash long, starts binary, copy boolean")
    return found.unionByName(copies)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text (kept words joined by blanks; unchanged if nothing goes), n_words, n_removed, kept_sha256, removed (spans
    of words) and the columns named in carry."""
    arrow_rows(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    rank = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST))
    base = docs.select(rank.alias("rank"), F.xxhash64(text).alias("text_hash"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("check"))
    marks = settle(redundant_windows(base)).select("rank", "text_hash", "starts", "copy")
    tidy(docs.sparkSession)
    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(rank.alias("rank"), F.xxhash64(text).alias("text_hash"), text.alias("text"), carried.alias("carried")).join(marks, ["rank", "text_hash"], "left")
    packed = rows.select(F.struct("rank", "carried").alias("row"), "text", "starts", F.coalesce("copy", F.lit(False)).alias("copy"))
    out = packed.mapInArrow(_cut, f"row {packed.schema['row'].dataType.simpleString()}, text string, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:long,end:long>>")
    doc_id = F.when(F.col("row.rank") != LAST, F.col("row.rank"))
    return out.select(doc_id.alias("doc_id"), "text", "n_words", "n_removed", "kept_sha256", "removed", *[F.col(f"row.carried.`{c}`").alias(c) for c in carry])
