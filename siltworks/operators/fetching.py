"""Bytes of many addresses, fetched by tasks with few requests at a time for each host."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siltworks import schema
from siltworks.functions import text as tx
from siltworks.session import shuffle_width

#: Takes an address; gives all its bytes, or its bytes in pieces as they come, or nothing.
Transport = Callable[[str], "bytes | Iterable[bytes] | None"]

#: Addresses that a task may hold while their hosts are busy.
WAITING = 65_536
#: Rows of a batch that a task hands on; TURN_BYTES end one, too.
GATHERED = 2048
#: A lane's turn ends after so many addresses, seconds or bytes; then another lane may have its thread.
TURN, TURN_SECONDS, TURN_BYTES = 512, 0.05, 1 << 20


class TooLarge(ValueError):
    """There are more bytes than may be kept."""


def body(got: bytes | Iterable[bytes] | None, max_bytes: int) -> bytes | None:
    """What a transport has given, as bytes; of pieces no more are taken than tell that there are too many."""
    if got is None:
        return None
    kept = bytearray()
    for piece in [got] if isinstance(got, (bytes, bytearray, memoryview)) else got:
        if len(kept) + len(piece) > max_bytes:
            if hasattr(got, "close"):
                got.close()
            raise TooLarge(f"Too large: more than {max_bytes} bytes")
        kept += piece
    return bytes(kept)


def in_lanes(rows: Iterator[tuple[str, Any]], work: Callable[[Any], Any], threads: int, waiting: int = WAITING, size: Callable[[Any], int] = lambda _: 0) -> Iterator:
    """work(row) of (lane, row), as they are done: one at a time in each lane, `threads` at a time in all. A slow lane holds up no other, as long as no
    more than `waiting` of its rows are there. A lane keeps a thread for a turn, so that quick work costs no change of threads for each row; size
    tells the bytes of a result, of which a turn gathers TURN_BYTES and one result more at most."""
    queues: dict[str, deque] = {}
    ready: deque[str] = deque()  # lanes with rows and none at work
    busy: dict = {}
    held, more = 0, True

    def turn(some: list) -> list:
        done, kept, until = [], 0, time.monotonic() + TURN_SECONDS
        for row in some:
            done.append(work(row))
            kept += size(done[-1])
            if kept >= TURN_BYTES or time.monotonic() >= until:
                break
        return done

    pool = ThreadPoolExecutor(threads)
    try:
        while True:
            while more and held < waiting:
                lane, row = next(rows, (None, None))
                if row is None:
                    more = False
                    break
                held += 1
                if lane not in queues:
                    queues[lane] = deque()
                    ready.append(lane)
                queues[lane].append(row)
            while ready and len(busy) < threads:
                lane = ready.popleft()
                some = [queues[lane].popleft() for _ in range(min(TURN, len(queues[lane])))]
                busy[pool.submit(turn, some)] = lane, some
            if not busy:
                return
            done, _ = wait(busy, return_when=FIRST_COMPLETED)
            for one in done:
                lane, some = busy.pop(one)
                got = one.result()
                held -= len(got)
                queues[lane].extendleft(reversed(some[len(got) :]))
                if queues[lane]:
                    ready.append(lane)
                else:
                    del queues[lane]
                yield from got
    finally:
        pool.shutdown(cancel_futures=True)


FETCHED = "resource_id STRING, node_id STRING, media_id STRING, content BINARY, error STRING"


def fetch(plan: DataFrame, transport: Transport, *, max_bytes: int, per_host: int = 4, threads: int = 8, parts: int | None = None) -> DataFrame:
    """Bytes of the planned media that are not deferred: resource_id, node_id, media_id, content, error.

    Addresses are dealt by host and a number below per_host, so a host that has most of them is asked by several tasks, and never by more than
    per_host requests at a time (a task that Spark repeats or runs twice comes on top). A task keeps at most two bodies of max_bytes and twice TURN_BYTES for each of
    its `threads`. One failure does not end the others; a body beyond max_bytes is a failure, and is not read to its end where the transport gives pieces.
    """
    host = tx.host_of(F.col("source_uri"))
    lane = F.concat(host, F.lit(" "), F.pmod(F.xxhash64("resource_id", "node_id", "media_id"), F.lit(per_host)).cast("string"))
    todo = plan.where("NOT deferred").select("resource_id", "node_id", "media_id", "source_uri", lane.alias("lane"))
    dealt = todo.repartition(parts or shuffle_width(plan.sparkSession), "lane")
    ddl = schema.struct(FETCHED)
    arrow = to_arrow_schema(ddl)

    def work(row: tuple) -> tuple:
        *keys, uri, _ = row
        try:
            content, error = body(transport(uri), max_bytes), None
        except Exception as e:  # noqa: BLE001 recorded per item
            content, error = None, str(e) or type(e).__name__
        return *keys, content, error

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planned = ((row[-1], row) for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
        size = lambda got: len(got[3] or b"")
        packed = lambda some: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), arrow, strict=True)], schema=arrow)
        out, kept = [], 0
        for got in in_lanes(planned, work, threads, size=size):
            out.append(got)
            kept += size(got)
            if kept >= TURN_BYTES or len(out) >= GATHERED:
                yield packed(out)
                out, kept = [], 0
        if out:
            yield packed(out)

    return dealt.mapInArrow(rows, ddl)
