"""Best-fit packing of tokenized documents, with repacking that lower bounds certify.

Documents become pieces of at most a sequence's length. Pieces are dealt to partitions by hash and packed there best-fit
decreasing. For each partition, dual-feasible functions give a lower bound of its number of sequences. Where the packing
meets the bound, it is certified and only its emptiest sequence is opened again; where there is a gap, all
sequences with more free space than the gap explains are opened. Opened sequences hand their pieces to a pool, which is dealt
anew and packed again.

Why the rounds end. A round of exchange is followed by another only if it packed the pool into fewer sequences than were opened for it, by one in
SAVING at least; the number of all sequences falls with each, so there are finitely many, and EXCHANGES at most. After that every partition
keeps all but its emptiest sequence. Such a sequence holds `length` pieces at most, so as long as partitions hold `per_partition` pieces the pool shrinks to
length / per_partition of its size from round to round, until one partition packs what is left; if a pool does not shrink to half, its packing
stands. Partitions hold a bounded number of pieces, whatever the input. Each row names its partition's bound and number of sequences;
`certificate` compares all sequences with the bound of all pieces.

Defined results: null texts are empty texts, of one piece with the end token alone; repeated rows are documents of their own and packed
as such; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import arrow_rows, settle

LENGTH = 1024
END = 2
#: Pieces in one partition of a packing round, about.
PER_PARTITION = 50_000
#: A round of exchange must save one of so many opened sequences for another to follow, and there are so many at most.
SAVING, EXCHANGES = 200, 12
#: Remembered parts of texts in one generation.
MEMORY = 400_000
#: Texts whose unknown parts are encoded together.
TOGETHER = 32

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Where a blank stands between white space, or behind it at the end, tokens can span it.
_SPANNED = re.compile(r"\s (?:\s|\Z)")
#: Parts that can be encoded one behind the other, as one text.
_SIMPLE = re.compile(r"\S+\Z")


def cuts_at_blanks(settings: dict) -> bool:
    """Whether a tokenizer never joins what lies before a single blank with the blank: byte-level words without normalisation."""
    before = settings.get("pre_tokenizer") or {}
    words = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", False)
    return words and settings.get("normalizer") is None and settings.get("model", {}).get("type") == "BPE" and not any(t.get("lstrip") or t.get("rstrip") for t in settings.get("added_tokens", ()))


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers, by tokenizers.

    Where the file's settings say that a token never spans the place before a single blank, texts are cut there and the parts' ids are
    remembered, the last ones in two generations of bounded size; the parts of a batch that are not remembered are encoded together. Texts with
    longer white space or with the string of a special token, and all texts under other settings, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.in_parts = cuts_at_blanks(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # byte-level vocabularies write each byte as one letter
        self.n_bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, parts: list[str]) -> None:
        """Remembers the ids of parts, each with the blank before it."""
        if len(self.known) + len(parts) > MEMORY:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        known.update((p, older[p]) for p in parts if p in older)
        new = [p for p in parts if p not in known]
        run = [p for p in new if _SIMPLE.match(p)]
        if run:
            # One text of all these parts; the bytes that its tokens cover tell which belong to which part.
            ids = np.frombuffer(self.plain([" " + " ".join(run)])[0], "<u4")
            ends = np.cumsum([len(p.encode()) + 1 for p in run])
            covered = np.cumsum(self.n_bytes[ids])
            cuts = np.searchsorted(covered, ends) + 1
            if (covered[cuts - 1] == ends).all():
                raw, at = ids.tobytes(), 0
                for part, cut in zip(run, (4 * cuts).tolist(), strict=True):
                    known[part], at = raw[at:cut], cut
                new = [p for p in new if p not in known]
        known.update(zip(new, self.plain([" " + p for p in new]), strict=True))

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        whole = [not self.in_parts or bool(_SPANNED.search(t)) or any(s in t for s in self.specials) for t in texts]
        others = iter(self.plain([t for t, w in zip(texts, whole, strict=True) if w]))
        for at in range(0, len(texts), TOGETHER):
            some = [None if w else t.split(" ") for t, w in zip(texts[at : at + TOGETHER], whole[at : at + TOGETHER], strict=True)]
            firsts = iter(self.plain([parts[0] for parts in some if parts]))
            found = [parts and list(map(self.known.get, parts[1:])) for parts in some]
            unknown = {p for parts, ids in zip(some, found, strict=True) if parts and None in ids for p, x in zip(parts[1:], ids, strict=True) if x is None}
            if unknown:
                self._learn(sorted(unknown))
                found = [ids and [self.known[p] if x is None else x for p, x in zip(parts[1:], ids, strict=True)] if ids and None in ids else ids for parts, ids in zip(some, found, strict=True)]
            for ids in found:
                yield next(others) if ids is None else next(firsts) + b"".join(ids)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words, each with a blank before it; only where the settings cut texts at blanks do they add up to those of a text."""
        found = list(map(self.known.get, words))
        if None in found:
            self._learn([w for w, x in zip(words, found, strict=True) if x is None])
            found = [self.known[w] if x is None else x for w, x in zip(words, found, strict=True)]
        return found

    def encode(self, text: str) -> bytes:
        return next(self.encode_batch([text]))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, length: int) -> list[int]:
    """Where the pieces of n ids begin; the first may be shorter than the others."""
    return [0, *range(n % length or length, n, length)]


def pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece of a document: doc_id, piece, start, length, ids_crc32, in any order."""
    arrow_rows(docs.sparkSession)
    end = np.asarray([END], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        encode = encoder(tokenizer_path).encode_batch
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            out = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts), strict=True):
                ids += end
                n = len(ids) // 4
                starts = cut(n, length)
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                    out.append((doc_id, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], strict=True)], names)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(rows, PIECES)


def lower_bound(sizes: np.ndarray, length: int = LENGTH) -> int:
    """No packing of these sizes has fewer sequences."""
    return bound_of_counts(np.bincount(sizes, minlength=length + 1), length)


def bound_of_counts(counts: np.ndarray, length: int = LENGTH) -> int:
    """The best of two families of dual-feasible functions, from the number of pieces of each size.

    Rounding functions u_k: sizes times k + 1, in lengths, count whole if divisible, else rounded down, over k. Threshold functions:
    sizes above length - t count as a full sequence, those below t as nothing, others as they are.
    """
    s = np.arange(length + 1)
    best = int(-(-(counts * s).sum() // length))
    for t in range(1, length // 2 + 1):
        value = int(counts[length - t + 1 :].sum()) * length + int((counts[t : length - t + 1] * s[t : length - t + 1]).sum())
        best = max(best, -(-value // length))
    for k in range(1, 100):
        scaled = s * (k + 1)
        value = np.where(scaled % length == 0, s * k, (scaled // length) * length)  # in units of 1 / (k * length)
        best = max(best, int(-(-int((counts * value).sum()) // (k * length))))
    return best


def best_fit_decreasing(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its sequence, and for each sequence its free space; sequences are looked up by free space in a bit set."""
    where = np.empty(len(sizes), np.int64)
    open_by_space: list[list[int]] = [[] for _ in range(length + 1)]
    free: list[int] = []
    bits = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            stack = open_by_space[space]
            at = stack.pop()
            if not stack:
                bits &= ~(1 << space)
        else:
            at, space = len(free), length
            free.append(length)
        space -= size
        where[i], free[at] = at, space
        if space:
            open_by_space[space].append(at)
            bits |= 1 << space
    return where, np.asarray(free, np.int64)


def emptiest(free: np.ndarray) -> np.ndarray:
    """Marks the emptiest sequence, unless it is full."""
    opened = np.zeros(len(free), bool)
    if len(free) and free.max() > 0:
        opened[int(free.argmax())] = True
    return opened


def to_open(free: np.ndarray, bound: int, length: int = LENGTH) -> np.ndarray:
    """Which sequences of a packed partition give their pieces back for an exchange."""
    gap = len(free) - bound
    if gap <= 0:
        return emptiest(free)
    # The emptiest sequences, until their free space would hold the sequences too many twice over.
    order = np.argsort(-free, kind="stable")
    enough = int(np.searchsorted(np.cumsum(free[order]), 2 * gap * length)) + 1
    opened = np.zeros(len(free), bool)
    opened[order[:enough]] = True
    return opened & (free > 0)


ROUND = "doc_id long, piece int, start long, length long, ids_crc32 long, tie long, sequence_id long, offset long, partition_bound long, partition_sequences long, opened boolean"


def _pack_partition(number: int, step: str, length: int):
    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "tie", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        sizes = rows["length"].to_numpy()
        where, free = best_fit_decreasing(sizes, length)
        bound = lower_bound(sizes, length)
        opened = np.zeros(len(free), bool) if step == "last" else to_open(free, bound, length) if step == "exchange" else emptiest(free)
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.append(True, where[order][1:] != where[order][:-1])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - np.repeat((ends - sizes[order])[first], np.diff(np.append(np.flatnonzero(first), len(sizes))))
        done = rows.assign(sequence_id=(np.int64(number) << 56) + (np.int64(key[0]) << 32) + where, offset=offset, partition_bound=bound, partition_sequences=len(free), opened=opened[where])
        return done[[x.split()[0] for x in ROUND.split(", ")]]

    return pack


def pack(rows: DataFrame, *, length: int = LENGTH, per_partition: int = PER_PARTITION) -> DataFrame:
    """pieces() rows with sequence_id, offset, partition_bound, partition_sequences."""
    # Full pieces are sequences of their own; the rest has a place by hash, the same in every run.
    left = settle(rows.withColumn("tie", F.xxhash64("doc_id", "piece", "ids_crc32")))
    one = F.lit(1).cast("long")
    alone = [(F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), one.alias("partition_bound"), one.alias("partition_sequences")]
    full = left.where(F.col("length") == length).select(*[c for c in left.columns if c != "tie"], *alone)
    left = left.where(F.col("length") < length)
    done, n, number, step = [settle(full)], left.count(), 0, "exchange"
    opened_before = None  # sequences that the pool came from
    while n:
        parts = max(1, -(-n // per_partition))
        step = "last" if parts == 1 else step
        dealt = left.withColumn("part", F.pmod(F.xxhash64("tie", F.lit(number)), F.lit(parts)).cast("int")) if parts > 1 else left.withColumn("part", F.lit(0))
        packed = settle(dealt.groupBy("part").applyInPandas(_pack_partition(number, step, length), ROUND))
        begins = F.col("offset") == 0  # one piece of each sequence
        made = packed.agg(F.count_if(begins).alias("all"), F.count_if(begins & F.col("opened")).alias("opened"), F.count_if("opened").alias("pieces")).first()
        exchanged = step == "exchange" and number + 1 < EXCHANGES and (opened_before is None or (opened_before - made["all"]) * SAVING >= opened_before)
        if step == "exchange" and not exchanged or step == "gather" and 2 * made["pieces"] > n:
            # This packing stands; of an exchange only the emptiest sequence of each partition is opened.
            step = "gather" if step == "exchange" else "last"
            if step == "gather":
                packed = _only_emptiest(packed, length)
                made = packed.agg(F.count_if(begins & F.col("opened")).alias("opened"), F.count_if("opened").alias("pieces")).first()
        if step == "last":
            done.append(packed.select(*full.columns))
            break
        done.append(packed.where("not opened").select(*full.columns))
        left = packed.where("opened").select(*left.columns)
        n, opened_before, number = made["pieces"], made["opened"], number + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _only_emptiest(packed: DataFrame, length: int) -> DataFrame:
    """Rows of a round of exchange, with one opened sequence at most for each of its partitions."""
    part = F.shiftright("sequence_id", 32)
    used = packed.where("opened").groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < length)
    chosen = used.groupBy(part.alias("part")).agg(F.min_by("sequence_id", F.struct("used", "sequence_id")).alias("sequence_id"))
    return settle(packed.drop("opened").join(chosen.select("sequence_id", F.lit(True).alias("opened")), "sequence_id", "left").fillna(False, ["opened"]).select(*packed.columns))


def certificate(packed: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """One row: n_sequences, and the bound below which no packing of all these pieces can go, from their number of each length."""
    counts = np.zeros(length + 1, np.int64)
    for r in packed.groupBy("length").count().collect():  # length rows at most
        counts[r["length"]] = r["count"]
    return packed.agg(F.countDistinct("sequence_id").alias("n_sequences"), F.lit(bound_of_counts(counts, length)).cast("long").alias("bound"))


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, partition_bound, partition_sequences."""
    return pack(pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, length=length), length=length)
