"""Quality rules from repetition coverage.

Words are numbered, windows of several lengths are hashed by a rolling combination of the numbers, and all characters (of words)
inside windows that occur twice or more in the text are counted once. Lines that repeat an earlier line are measured
in characters too. A text fails when the share of its characters inside duplicated windows of some length, or in duplicated
lines, is above that measure's limit; and it fails the base rules when it has few words or many words in repeated 5-word windows.

Defined results: a null or empty text has zero counts and fails the base rules; repeated rows get equal results each; an empty
table gives an empty result. Only the id and text columns are read, so other names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.llm.words import mix64, stream
from siltworks.session import arrow_rows

SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PERCENT = 20
#: Window length in words: the greatest share of characters inside duplicated windows that is kept.
LIMITS = {5: 0.20, 7: 0.18, 10: 0.15}
LINE_LIMIT = 0.30

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double, " + ", ".join(f"coverage_{n} double" for n in LIMITS)

_NOT_COUNTED = bytes([*range(0x80, 0xC0), 9, 10, 11, 12, 13, 32])  # continuation bytes and white space
_FACTORS = {n: stream(100 + n, n) | np.uint64(1) for n in LIMITS}


def repeated(ids: np.ndarray, n: int) -> np.ndarray:
    """For each word: whether it lies in a window of n words that occurs twice or more; first occurrences included."""
    count = len(ids) - n + 1
    inside = np.zeros(len(ids), bool)
    if count < 2:
        return inside
    h = np.zeros(count, np.uint64)
    for j, m in enumerate(_FACTORS[n]):
        h += ids[j : j + count] * m
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if same.any():
        hit = np.zeros(count + 1, np.int64)
        starts = np.zeros(count, bool)
        starts[order[1:][same]] = True
        starts[order[:-1][same]] = True
        hit = np.zeros(len(ids) + 1, np.int64)
        at = np.flatnonzero(starts)
        hit[at] += 1
        hit[at + n] -= 1
        inside = np.cumsum(hit[:-1]) > 0
    return inside


def measure(text: bytes) -> tuple:
    """The row of a text, without its id."""
    words = text.split()
    number: dict[bytes, int] = {}
    ids = mix64(np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words)))
    chars = np.fromiter(map(len, words), np.int64, len(words)) if text.isascii() else np.fromiter((len(w.translate(None, _NOT_COUNTED)) for w in words), np.int64, len(words))
    total = int(chars.sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in text.split(b"\n"):
        if line in seen:
            if line.strip():
                dup_lines += 1
                dup_line_chars += len(line.translate(None, _NOT_COUNTED))
        else:
            seen.add(line)
    shares, n_repeat = [], 0
    for n in LIMITS:
        inside = repeated(ids, n)
        if n == BASE_WINDOW:
            n_repeat = int(inside.sum())
        shares.append(float(chars[inside].sum()) / total if total else 0.0)
    lines = dup_line_chars / total if total else 0.0
    failed = len(words) < MIN_WORDS or 100 * n_repeat > MAX_REPEATED_PERCENT * len(words)
    kept = not failed and lines <= LINE_LIMIT and all(x <= limit for x, limit in zip(shares, LIMITS.values(), strict=True))
    return (len(words), total, symbols, dup_lines, n_repeat, failed, kept, lines, *shares)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * (1 + len(LIMITS))
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        columns = list(zip(*[measure(t or b"") for t in texts], strict=True)) if texts else [[] for _ in kinds[1:]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]], names)


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs, as SCHEMA says."""
    arrow_rows(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(_rows, SCHEMA)
