"""Passes over a table in pages of keys, with a checkpoint after each page, and when the next pass is due."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.sources.store import Store

#: Rows of a page, about, and the most pages of a pass: each page is one scan of its range of keys.
PAGE_ROWS = 1_000_000
MOST_PAGES = 64
#: Keys drawn for each page to find its ends.
DRAWN = 100


class Cancelled(RuntimeError):
    """The run was cancelled before it delivered anything."""


def page_ends(rows: DataFrame, key: str = "id", *, page_rows: int = PAGE_ROWS) -> list[str]:
    """The last keys of all pages but the last. They are drawn from a bounded sample and only balance the pages: every key belongs to
    exactly one page, whatever the ends are."""
    n = rows.count()
    pages = min(MOST_PAGES, -(-n // page_rows))
    if pages < 2:
        return []
    share = min(1.0, 2 * DRAWN * pages / n)
    keys = rows.select(key).where(F.col(key).isNotNull())
    drawn = sorted(r[0] for r in (keys if share == 1.0 else keys.sample(share, 1)).limit(4 * DRAWN * pages).collect())
    return sorted({drawn[len(drawn) * i // pages] for i in range(1, pages)}) if drawn else []


def within(key: str, ends: list, page: int) -> Column:
    """Whether a key belongs to a page; both ends reach the scan. Null keys belong to the first page."""
    inside = F.lit(True)
    if page > 0:
        inside = F.col(key) > F.lit(ends[page - 1])
    if page < len(ends):
        inside = inside & (F.col(key) <= F.lit(ends[page]))
    return inside | F.col(key).isNull() if page == 0 else inside


@dataclass
class Report:
    pages: int
    done_before: int
    completed_cleanly: bool
    error: str | None = None


def run_pass(store: Store, name: str, rows: Callable[[int], DataFrame], handle: Callable[[DataFrame, int], None], *, key: str = "id", page_rows: int = PAGE_ROWS, stop: Callable[[], bool] = lambda: False, at: int | None = None) -> Report:
    """Hands the pages of rows(snapshot) to handle(page, number), in key order.

    After each page the store remembers the snapshot, the ends of the pages and how many are done, so a pass that was interrupted goes on
    with the page it was at, over the rows that it began with; handle must be able to do that page again. A pass that comes to its end,
    or is stopped between pages, forgets all that. A page that fails ends the pass with a report and keeps the checkpoint.
    """
    mark = f"{name}_cursor"
    stored = store.get_state(mark)
    if stored is not None:
        state = json.loads(stored)
    else:
        snapshot = store.latest_number() if at is None else at
        state = {"snapshot": snapshot, "ends": page_ends(rows(snapshot), key, page_rows=page_rows), "done": 0}
        store.put_state(mark, json.dumps(state))
    before, ends = state["done"], state["ends"]
    try:
        for page in range(before, len(ends) + 1):
            if stop():
                raise Cancelled(name)
            handle(rows(state["snapshot"]).where(within(key, ends, page)), page)
            state["done"] = page + 1
            store.put_state(mark, json.dumps(state))
        if stop():
            raise Cancelled(name)
    except Cancelled:
        store.delete_state(mark)
        raise
    except Exception as error:  # noqa: BLE001 reported to the caller, who decides
        return Report(len(ends) + 1, before, False, str(error))
    store.delete_state(mark)
    return Report(len(ends) + 1, before, True)


def checkpoint_of(store: Store, name: str) -> dict | None:
    """The checkpoint of a pass that has not come to its end."""
    stored = store.get_state(f"{name}_cursor")
    return json.loads(stored) if stored else None


def next_due(ended_ms: Column, every_minutes: Column, completed_cleanly: Column, always: Column) -> Column:
    """When a periodic pass runs again, in milliseconds: a pass that did not end cleanly only if it is one that always runs again."""
    return F.when(always | completed_cleanly, ended_ms + every_minutes * 60_000)
