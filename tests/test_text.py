import pytest
from pyspark.sql import functions as F

from siltworks.functions import text as tx


def value(spark, column, **inputs):
    types = ", ".join(f"{k} string" for k in inputs) or "x string"
    return spark.createDataFrame([tuple(inputs.values()) or (None,)], types).select(column).first()[0]


@pytest.mark.parametrize(("raw", "path"), [("a/b/c", "a_b_c"), ('file:*?"<>|name', "file_______name"), ("hello world", "hello_world"), ("..abc..", "abc"), ("  name  ", "name"), ("x" * 300, "x" * 200), ("", "unnamed"), ("...", "unnamed"), ("a b", "a_b")])
def test_sanitize_path(spark, raw, path):
    assert value(spark, tx.sanitize_path(F.col("x")), x=raw) == path


@pytest.mark.parametrize(("kind", "shown"), [("text", "v"), ("heading", "## v"), ("quote", "> v"), ("code", "```\nv\n```"), ("list_item", "- v"), ("transcript", "**[Transcript]**\n\nv")])
def test_render_block(spark, kind, shown):
    assert value(spark, tx.render_block(F.col("k"), F.col("v")), k=kind, v="v") == shown


def plain_djb2(s):
    h = 5381
    data = s.encode("utf-16-be")
    for i in range(0, len(data), 2):
        h = (h * 33 + int.from_bytes(data[i : i + 2], "big")) % 2**32
    return f"{h:08x}"


@pytest.mark.parametrize("s", ["abc", "", "\U0001f3d4x", "é" * 50, "https://example.com/p/1/"])
def test_djb2(spark, s):
    assert value(spark, tx.djb2(F.col("x")), x=s) == plain_djb2(s)


def test_djb2_fixed_values(spark):
    assert plain_djb2("abc") == "0b885c8b"
    assert value(spark, tx.djb2(F.col("x")), x="") == "00001505"


@pytest.mark.parametrize(("raw", "shown"), [(None, "null"), ("", '""'), ("plain", "plain"), ("a: b", '"a: b"'), (" x", '" x"'), ('say "hi"', '"say \\"hi\\""'), ("a\nb", '"a\\nb"'), ("back\\slash", "back\\slash"), ("true", "true")])
def test_yaml_string(spark, raw, shown):
    assert value(spark, tx.yaml_string(F.col("x")), x=raw) == shown


IG = "https://www.instagram.com"


@pytest.mark.parametrize(("url", "kind"), [("/", "home-feed"), ("/dev/saved/all-posts/", "grid"), ("/nasa/", "grid"), ("/explore/tags/cats/", "grid"), ("/reels/", "reels"), ("/reel/x/", "reels"), ("/p/ABC/", "unknown"), ("/a/b/c/", "unknown")])
def test_surface_kind(spark, url, kind):
    assert value(spark, tx.surface_kind(F.col("x")), x=IG + url) == kind


@pytest.mark.parametrize(("root", "url", "on"), [("/", "/", True), ("/", "/p/ABC123/", False), ("/", "/nasa/", False), ("/dev/saved/all-posts/", "/p/ABC123/", True), ("/dev/saved/all-posts/", "/reel/XYZ/", True), ("/nasa/", "/nasa/", True), ("/nasa/", "/someoneelse/", False), ("/nasa/", "/nasa2/", True), ("/reels/", "/reels/1/", True), ("/p/x/", "/anything/", True)])
def test_is_on_surface(spark, root, url, on):
    assert value(spark, tx.is_on_surface(F.col("u"), F.col("s")), u=IG + url, s=IG + root) is on


def test_urls(spark):
    assert value(spark, tx.clean_url(F.col("x")), x=IG + "/p/1/?a=b#c") == IG + "/p/1/"
    assert value(spark, tx.clean_url(F.col("x")), x="not a url") == "not a url"
    assert value(spark, tx.surface_kind(F.col("x")), x="not a url") == "home-feed"
    assert value(spark, tx.external_id(F.col("x")), x=IG + "/reel/a_B-9/?x") == "a_B-9"
    assert value(spark, tx.external_id(F.col("x")), x=IG) == ""
    assert value(spark, tx.can_handle(F.col("x")), x="https://elsewhere.org/p/1/") is True
    assert value(spark, tx.can_handle(F.col("x")), x="https://elsewhere.org/q/1/") is False


def test_fingerprint_inputs(spark):
    c = F.lit
    assert value(spark, tx.fingerprint_text(c("u"), c(None), c(2), c("y" * 70))) == "u||2|" + "y" * 64


def test_iso_and_rounding(spark):
    assert value(spark, tx.iso_millis(F.lit("2024-01-01 00:00:00.123999").cast("timestamp"))) == "2024-01-01T00:00:00.123Z"
    assert value(spark, tx.js_round(F.lit(0.25), 1)) == 0.3


def test_crc32_check_value(spark):
    assert value(spark, F.crc32(F.lit("123456789").cast("binary"))) == 0xCBF43926
