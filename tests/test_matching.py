"""Wanted addresses on pages, against a comparison of all pairs."""

import random
from urllib.parse import urlsplit

from siltworks.operators import matching

PAGE = """<article><a href="/u/">u</a><a href="/p/A/">a</a></article><article><a href="/reel/R1/">r</a></article><article><a href="/x">x</a></article>
<div><a href="https://other.org/en/p/A/"><img></a><a href="/p/AB/?q=/reel/R1/"><img></a><a name="n">n</a></div>"""
LINKS, WANTED = "page_id long, pos int, href string", "page_id long, uri string"


def plain(links, wanted):
    out = set()
    for page, uri in set(wanted):
        parts = urlsplit(uri or "")
        path = (parts.path or "/") if parts.scheme and parts.netloc else ""
        hits = [(pos, h) for p, pos, h in links if p == page and page is not None and None not in (uri, h) and (h == uri or (path and path in h))]
        out.add((page, uri, *min(hits, default=(None, None))))
    return out


def run(spark, links, wanted, **options):
    return {tuple(r) for r in matching.first_match(spark.createDataFrame(links, LINKS), spark.createDataFrame(wanted, WANTED), **options).collect()}


def test_places(spark):
    pages = spark.createDataFrame([(1, "https://x.org/", PAGE), (2, None, None), (3, "https://x.org/", "")], "page_id long, url string, html string")
    got = {k: [tuple(r)[1:] for r in matching.places(pages, k).orderBy("pos").collect()] for k in matching.KINDS}
    assert got["article"] == [(0, "https://x.org/p/A/"), (1, "https://x.org/reel/R1/")]
    assert [p for p, _ in got["thumbnail"]] == [1, 2, 4, 5] and len(got["link"]) == 6


def test_random_paths_against_all_pairs(spark):
    r = random.Random(3)
    word = lambda: r.choice(["", "a", "ab", "abc", "abcd", "abcde", "abcdefgh", "ñandú", "p", "reel", "x.y"])
    path = lambda: "".join("/" + word() for _ in range(r.randrange(4)))
    links = [(r.randrange(3), i, r.choice(["https://h.org", "http://a", "", "ab"]) + path()) for i in range(300)]
    wanted = [(r.randrange(4), r.choice(["https://h.org", "https://other.net", ""]) + path()) for _ in range(200)]
    assert run(spark, links, wanted) == plain(links, wanted)
    everywhere = {(u, pos, h) for _, u, pos, h in plain([(0, p, h) for _, p, h in links], [(0, u) for _, u in wanted])}
    assert run(spark, links, wanted, by=()) == everywhere


def test_beginnings_wholes_and_odd_rows(spark):
    links = [(1, 0, "https://x/p/ABC/"), (1, 1, "https://x/p/AB"), (1, 2, "no address"), (1, 3, "https://x/p/AB"), (1, 4, None), (None, 0, "https://x/p/AB"), (2, 0, "https://x/" + "y" * 100_000)]
    wanted = [(1, "https://z/p/AB"), (1, "https://z/p/AB/"), (1, "https://z/p/AB"), (1, "no address"), (1, "no"), (1, None), (1, ""), (None, "https://x/p/AB"), (3, "https://x/p/AB"), (2, "https://z/yyy"), (1, "https://z")]
    got = {(p, u): at for p, u, at, _ in run(spark, links, wanted)}
    assert got == {(1, "https://z/p/AB"): 0, (1, "https://z/p/AB/"): None, (1, "no address"): 2, (1, "no"): None, (1, None): None, (1, ""): None, (None, "https://x/p/AB"): None, (3, "https://x/p/AB"): None, (2, "https://z/yyy"): 0, (1, "https://z"): 0}
    assert run(spark, [], wanted[:1]) == {(1, "https://z/p/AB", None, None)} and run(spark, links, []) == set()


def test_no_nested_loop(spark):
    links, wanted = spark.createDataFrame([], LINKS), spark.createDataFrame([], WANTED)
    plan = matching.first_match(links, wanted)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
