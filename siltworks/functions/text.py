"""Text functions as column expressions; none of them leaves the JVM.

Lengths and cuts count code points. Optional values that are null or empty count as absent wherever a rule says "if given".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as scripts in browsers define it (Java's \s leaves out some of it).
WHITE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"


def given(x: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(x != "", F.lit(False))


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{WHITE}]+|[{WHITE}]+$", "")


def djb2(x: Column) -> Column:
    """hash * 33 + unit modulo 2**32 over UTF-16 units, as 8 hexadecimal digits."""
    units = F.hex(F.encode(x, "UTF-16BE"))
    place = F.sequence(F.lit(0), F.greatest((F.length(units) / 4).cast("int") - 1, F.lit(0)))
    codes = F.transform(place, lambda i: F.conv(F.substr(units, i * 4 + 1, F.lit(4)), 16, 10).cast("long"))
    value = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + c) % (1 << 32))
    return F.lpad(F.lower(F.hex(F.when(F.length(x) == 0, F.lit(5381).cast("long")).otherwise(value))), 8, "0")


def fingerprint_text(uri: Column, author: Column, media_count: Column, caption: Column) -> Column:
    """The text that a fingerprint hashes: the four inputs, absent ones empty, the caption cut at 64."""
    empty = F.lit("")
    return F.concat_ws("|", F.coalesce(uri, empty), F.coalesce(author, empty), F.coalesce(media_count.cast("string"), empty), F.substring(F.coalesce(caption, empty), 1, 64))


def fingerprint(uri: Column, author: Column, media_count: Column, caption: Column) -> Column:
    return djb2(fingerprint_text(uri, author, media_count, caption))


def path_of(url: Column) -> Column:
    """A URL's path, "/" if it has none, empty if it is no URL."""
    path = F.try_parse_url(url, F.lit("PATH"))
    is_url = F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(url, F.lit("HOST")).isNotNull()
    return F.when(is_url, F.when(given(path), path).otherwise("/")).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit(""))


def clean_url(url: Column) -> Column:
    """Origin and path; a text that is no URL stays as it is."""
    origin = F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))))
    return F.when(path_of(url) != "", F.concat(origin, path_of(url))).otherwise(url)


def external_id(url: Column) -> Column:
    """The id in a permalink; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "/(?:p|reel)/([A-Za-z0-9_-]+)", 1)


def can_handle(url: Column) -> Column:
    return host_of(url).rlike(r"(^|\.)instagram\.com$") | path_of(url).rlike("/(p|reel)/")


# First path segments that are no user names.
RESERVED = ("p", "reel", "reels", "explore", "stories", "direct", "accounts", "about", "developer")


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def surface_kind(url: Column) -> Column:
    """home-feed, grid, reels or unknown, by the first rule that holds."""
    path = path_of(url)
    parts = _segments(path)
    profile = F.size(parts).between(1, 2) & ~F.get(parts, F.lit(0)).isin(*RESERVED)
    return (
        F.when(path.isin("", "/"), "home-feed")
        .when(path.startswith("/explore"), "grid")
        .when(path.startswith("/reels") | path.startswith("/reel/"), "reels")
        .when(path.rlike("^/[^/]+/saved(/|$)"), "grid")
        .when(profile, "grid")
        .otherwise("unknown")
    )


def surface_root(url: Column) -> Column:
    """The path under which a grid lies; null for other surfaces."""
    path = path_of(url)
    saved = F.regexp_extract(path, "^(/[^/]+/saved)(/|$)", 1)
    root = F.when(path.startswith("/explore"), "/explore").when(saved != "", saved).otherwise(F.concat(F.lit("/"), F.get(_segments(path), F.lit(0))))
    return F.when(surface_kind(url) == "grid", root)


def open_mode(url: Column) -> Column:
    return F.when(surface_kind(url) == "grid", "modal").otherwise("in-place")


def is_on_surface(url: Column, surface_url: Column) -> Column:
    """Whether url still belongs to the surface that surface_url opened. A grid's root matches as a prefix, with no boundary."""
    path, kind = path_of(url), surface_kind(surface_url)
    return (
        F.when(kind == "home-feed", path.isin("", "/"))
        .when(kind == "reels", path.startswith("/reels"))
        .when(kind == "grid", path.startswith(surface_root(surface_url)) | path.rlike("^/(p|reel)/"))
        .otherwise(True)
    )


def sanitize_path(x: Column) -> Column:
    """A file name: separators and white space become underscores, edges are stripped, 200 characters are kept."""
    x = F.regexp_replace(F.regexp_replace(x, r'[/\\:*?"<>|]', "_"), f"[{WHITE}]+", "_")
    x = F.substring(F.regexp_replace(x, f"^[.{WHITE}_]+|[.{WHITE}_]+$", ""), 1, 200)
    return F.when(x == "", "unnamed").otherwise(x)


def render_block(kind: Column, value: Column) -> Column:
    """Markdown of a content block; an unknown kind gives null."""
    return (
        F.when(kind == "text", value)
        .when(kind == "heading", F.concat(F.lit("## "), value))
        .when(kind == "quote", F.concat(F.lit("> "), value))
        .when(kind == "code", F.concat(F.lit("```\n"), value, F.lit("\n```")))
        .when(kind == "list_item", F.concat(F.lit("- "), value))
        .when(kind == "transcript", F.concat(F.lit("**[Transcript]**\n\n"), value))
    )


def yaml_string(x: Column) -> Column:
    """null, or the text, quoted and escaped where plain YAML would not give it back."""
    quote = (x == "") | x.rlike("[\\n:#\"']") | x.startswith(" ") | x.endswith(" ")
    escaped = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(x.isNull(), "null").when(quote, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(x)


def iso_millis(ts: Column) -> Column:
    """ISO 8601 in UTC with milliseconds, a form whose text order is the order of time; finer fractions are cut off."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def js_round(x: Column, digits: int = 0) -> Column:
    """Half is rounded up."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def media_folder(kind: Column) -> Column:
    return F.when(kind == "image", "images").when(kind == "video", "videos").when(kind == "audio", "audio").when(kind == "document", "documents").otherwise("other")


def blob_path(media_id: Column, kind: Column) -> Column:
    return F.concat(F.lit("media/"), media_folder(kind), F.lit("/"), media_id)


def meta_path(media_id: Column) -> Column:
    return F.concat(F.lit("media/meta/"), media_id, F.lit(".json"))


def note_path(kind: Column, resource_id: Column) -> Column:
    return F.concat(kind, F.lit("/"), sanitize_path(resource_id), F.lit(".md"))


def attachment_path(media_id: Column) -> Column:
    return F.concat(F.lit("attachments/"), sanitize_path(media_id))
