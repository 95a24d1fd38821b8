"""Fetching by lanes: how many at a time, slow hosts, large bodies."""

import threading
import time

import pytest

from siltworks.operators import fetching

PLAN = "resource_id string, node_id string, media_id string, source_uri string, deferred boolean"


def plan(spark, *uris):
    return spark.createDataFrame([("r", "r", f"m{i}", u, False) for i, u in enumerate(uris)] + [("r", "r", "later", "https://a/x", True)], PLAN)


def most_at_once(spans):
    ends = sorted([(a, 1) for a, _ in spans] + [(b, -1) for _, b in spans])
    now = most = 0
    for _, d in ends:
        now += d
        most = max(most, now)
    return most


def test_requests_for_a_host_are_few_and_a_slow_one_delays_itself(spark):
    def transport(uri):
        start = time.time()
        time.sleep(0.8 if "slow" in uri else 0.03)
        return f"{start} {time.time()}".encode()

    uris = [f"https://slow/{i}" for i in range(4)] + [f"https://busy/{i}" for i in range(60)] + [f"https://h{i}/x" for i in range(12)]
    got = fetching.fetch(plan(spark, *uris), transport, max_bytes=100, per_host=2, parts=2).collect()
    spans = {u: tuple(map(float, bytes(next(r["content"] for r in got if r["media_id"] == f"m{i}")).split())) for i, u in enumerate(uris)}
    of = lambda host: [s for u, s in spans.items() if f"//{host}/" in u]
    assert len(got) == len(uris) and most_at_once(of("busy")) <= 2 and most_at_once(of("slow")) <= 2
    assert max(b for a, b in of("busy")) < max(b for a, b in of("slow"))


def test_bodies(spark):
    def transport(uri):
        kind = uri.rsplit("/", 1)[1]
        if kind == "endless":
            return (b"x" * 10 if i < 4 else 1 / 0 for i in range(9))
        return {"none": None, "empty": b"", "fits": b"x" * 25, "over": b"x" * 26, "pieces": iter([b"ab", b"", b"c"])}[kind]

    kinds = ("none", "empty", "fits", "over", "pieces", "endless", "missing")
    got = fetching.fetch(plan(spark, *[f"https://a/{k}" for k in kinds]), transport, max_bytes=25)
    found = {kinds[int(r["media_id"][1:])]: (None if r["content"] is None else bytes(r["content"]), r["error"]) for r in got.collect()}
    large = (None, "Too large: more than 25 bytes")
    assert found == {"none": (None, None), "empty": (b"", None), "fits": (b"x" * 25, None), "over": large, "pieces": (b"abc", None), "endless": large, "missing": (None, "'missing'")}
    assert fetching.fetch(plan(spark), transport, max_bytes=1).collect() == []


@pytest.mark.parametrize("waiting", [1, 3, 1000])
def test_lanes(waiting):
    rows = [(f"l{i % 5}", {"i": i}) for i in range(200)]
    at_work, broken = {f"l{i}": 0 for i in range(5)}, []

    def work(row):
        lane = f"l{row['i'] % 5}"
        at_work[lane] += 1
        if at_work[lane] > 1:
            broken.append(row)
        time.sleep(0.0005)
        at_work[lane] -= 1
        return row

    got = list(fetching.in_lanes(iter(rows), work, 3, waiting))
    assert sorted(r["i"] for r in got) == list(range(200)) and not broken
    assert all([r["i"] for r in got if r["i"] % 5 == n] == list(range(n, 200, 5)) for n in range(5))
    assert list(fetching.in_lanes(iter([]), work, 3)) == []


def test_quick_addresses_of_one_host_share_turns_and_batches(spark):
    threads = set()

    def work(row):
        threads.add(threading.get_ident())
        return row

    turns = []

    class Pool(fetching.ThreadPoolExecutor):
        def submit(self, *args):
            turns.append(1)
            return super().submit(*args)

    before, fetching.ThreadPoolExecutor = fetching.ThreadPoolExecutor, Pool
    try:
        assert list(fetching.in_lanes((("one", i) for i in range(1, 20_001)), work, 4)) == list(range(1, 20_001))
    finally:
        fetching.ThreadPoolExecutor = before
    assert len(turns) < 4_000 and len(threads) <= 4  # 20,000 when each row was a turn


def test_a_turn_ends_with_its_bytes():
    most, now = [0], [0]

    def work(row):
        now[0] += 1
        most[0] = max(most[0], now[0])
        return bytes(fetching.TURN_BYTES // 2)

    for _ in fetching.in_lanes((("one", i) for i in range(1, 41)), work, 1, size=len):
        now[0] -= 1
    assert most[0] <= 4
