"""Where wanted addresses appear on captured pages: the first article, thumbnail or link whose address is the wanted one or holds its path.

"Holds" is a comparison of texts and would need every wanted address against every link. A path that an address holds has all its
inner segments in it, whole, and its last one at least as the beginning of a segment. So both sides are joined on the path's rarest segment (or
beginning), and only what shares it is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from siltworks import schema
from siltworks.functions import text as tx
from siltworks.operators.extract import post_link
from siltworks.session import settle
from siltworks.sources.html import Page, parse

PLACES = "page_id BIGINT, pos INT, href STRING"


def _articles(page: Page) -> Iterator[tuple[int, str]]:
    for pos, article in enumerate(page.all("article")):
        if (link := post_link(article)) is not None:
            yield pos, link.link("href")


def _links(page: Page) -> Iterator[tuple[int, str]]:
    return ((pos, a.link("href")) for pos, a in enumerate(page.all("a", lambda a: bool(a.get("href")))))


def _thumbnails(page: Page) -> Iterator[tuple[int, str]]:
    return ((pos, href) for pos, href in _links(page) if "/p/" in href or "/reel/" in href)


#: What a place is: an article with its permalink, a link to a post, any link.
KINDS = {"article": _articles, "thumbnail": _thumbnails, "link": _links}


def places(pages: DataFrame, kind: str) -> DataFrame:
    """page_id, pos (of all articles or links of the page, from 0), href (resolved) of the pages' (page_id, url, html) places of a kind."""
    ddl, of = schema.struct(PLACES), KINDS[kind]
    arrow = to_arrow_schema(ddl)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, html in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                out += [{"page_id": page_id, "pos": pos, "href": href} for pos, href in of(parse(html, url))]
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(rows, ddl)


def _power(length: Column) -> Column:
    """The exponent of the greatest power of two that is at most length (1 or more)."""
    return F.length(F.bin(length)) - 1


def _held(href: Column) -> Column:
    """Keys under which an address is found: itself, its whole segments, and beginnings of segments whose lengths are 0 or powers of two."""
    parts = F.split(href, "/")
    after = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))  # a path begins with a slash, so the text before the first one is in none
    whole = F.transform(F.slice(after, 1, F.greatest(F.size(after) - 1, F.lit(0))), lambda s: F.concat(F.lit("whole "), s))
    powers = lambda s: F.when(F.length(s) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), _power(F.length(s))))
    begins = F.transform(after, lambda s: F.concat(F.array(F.lit("begins ")), F.transform(powers(s), lambda n: F.concat(F.lit("begins "), F.substring(s, F.lit(1), F.pow(F.lit(2), n).cast("int"))))))
    return F.array_distinct(F.concat(F.array(F.concat(F.lit("is "), href)), whole, F.flatten(begins)))


def _asked(path: Column, uri: Column) -> Column:
    """Keys of which an address that matches has every one."""
    parts = F.split(path, "/")
    whole = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda s: F.concat(F.lit("whole "), s))
    last = F.element_at(parts, -1)
    begins = F.when(F.length(last) == 0, "begins ").otherwise(F.concat(F.lit("begins "), F.substring(last, F.lit(1), F.pow(F.lit(2), _power(F.length(last))).cast("int"))))
    return F.when(path == "", F.array(F.concat(F.lit("is "), uri))).otherwise(F.array_append(whole, begins))


def first_match(found: DataFrame, wanted: DataFrame, *, by: tuple[str, ...] = ("page_id",), order: tuple[str, ...] = ("pos",)) -> DataFrame:
    """Each distinct wanted row (by, uri) with the first place, in `order`, among those of equal `by`: its order columns and href, null where there is none.

    A place matches if its href is the uri or holds its path; a uri that is no address has no path and is only compared as a whole. Without
    `by` all places are searched. Rows with a null in `by`, uri or href match nothing. Equal addresses and equal paths meet once, and of the matches of
    a path only the least leaves a task, so a path that all addresses hold costs no more than they are.
    """
    by, order = list(by), list(order)
    # both are read several times, and finding places means parsing pages
    addresses = settle(found.where(F.col("href").isNotNull()).groupBy(*by, "href").agg(F.min(F.struct(*order)).alias("_at")))
    asked = settle(wanted.select(*by, "uri").distinct()).withColumn("_path", tx.path_of(F.col("uri")))
    asked = asked.withColumn("_needle", F.when(F.col("_path") == "", F.col("uri")).otherwise(F.col("_path")))
    needles = asked.where("uri is not null").select(*by, "_needle", (F.col("_path") == "").alias("_whole")).distinct()
    keys = needles.select("*", F.explode(_asked(F.when(F.col("_whole"), "").otherwise(F.col("_needle")), F.col("_needle"))).alias("_key"))
    held = addresses.select("*", F.explode(_held(F.col("href"))).alias("_key"))
    often = held.groupBy(*by, "_key").agg(F.count("*").alias("_n"))
    rarest = keys.join(often, [*by, "_key"], "left").groupBy(*by, "_needle", "_whole").agg(F.min_by("_key", F.struct(F.coalesce("_n", F.lit(0)), "_key")).alias("_key"))
    same = F.when(F.col("_whole"), F.col("href") == F.col("_needle")).otherwise(F.contains(F.col("href"), F.col("_needle")))
    matches = rarest.join(held, [*by, "_key"]).where(same)
    first = matches.groupBy(*by, "_needle", "_whole").agg(F.min(F.struct("_at", "href")).alias("_first"))
    out = asked.withColumn("_whole", F.col("_path") == "").join(first, [*by, "_needle", "_whole"], "left")
    return out.select(*by, "uri", *[F.col(f"_first._at.{c}").alias(c) for c in order], F.col("_first.href").alias("href"))
