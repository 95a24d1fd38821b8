"""Connectors: what a provider brings along, the choice among them by address, and flags that switch stages on and off."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltworks.functions import text as tx
from siltworks.operators import extract, normalize


@dataclass(frozen=True)
class Connector:
    """Column and table functions of one provider; all of them are lazy."""

    provider: str
    can_handle: Callable[[Column], Column]
    discover: Callable[..., DataFrame]
    extract: Callable[..., DataFrame]
    normalize: Callable[[DataFrame, Column], DataFrame]


INSTAGRAM = Connector(extract.PROVIDER, tx.can_handle, extract.discover, extract.extract, lambda posts, at: normalize.normalize(normalize.enrich(posts), at))
CONNECTORS: Sequence[Connector] = (INSTAGRAM,)


def route(url: Column, connectors: Sequence[Connector] = CONNECTORS) -> Column:
    """The provider of the first connector that can handle an address; null if none can."""
    out = F.lit(None).cast("string")
    for c in reversed(connectors):
        out = F.when(c.can_handle(url), c.provider).otherwise(out)
    return out


def resources(pages: DataFrame, extracted_at: Column, connector: Connector = INSTAGRAM) -> tuple[DataFrame, DataFrame]:
    """Resources of the pages that a connector can handle, and the articles from which no strategy made one."""
    found = connector.extract(pages.where(connector.can_handle(F.col("url"))))
    posts = found.where("strategy IS NOT NULL").select("post.*")
    return connector.normalize(posts, extracted_at), found.where("strategy IS NULL").select("page_id", "article", "failure")


#: Stages and whether they run; a deployment passes its own.
FLAGS = {"discovery": True, "capture": True, "ocr": True, "export": True}


def gate(df: DataFrame, flag: str, flags: dict[str, bool] | None = None) -> DataFrame:
    """df, or no row of it if the stage is off; an unknown stage is off."""
    return df if (FLAGS if flags is None else flags).get(flag, False) else df.limit(0)
