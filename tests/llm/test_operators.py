"""Each operator against a plain restatement, and on odd inputs: nulls, empty and long texts, ties, repeated rows, no rows."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siltworks.llm import chat, fingerprint, license, license_texts, mixing, neardup, packing, quality, queries, sharding, substring, toxicity
from tests.llm import helpers as h

ODD = [None, "", " \n\t", "one", "one two three four five six", "one two three four five six", "x" * 5000, " ".join(f"w{i % 7}" for i in range(3000)), "é ß 𝄞   nb"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, guest boolean, row string, rank long, k string, size long"


@pytest.fixture(scope="module")
def sample(spark, data_dir):
    docs = spark.read.parquet(f"{data_dir}/documents.parquet")
    return docs, [(r["doc_id"], r["text"]) for r in docs.collect()]


def odd(spark):
    """Odd texts, a null id, repeated rows, and columns named as the operators' own."""
    rows = [(i, t, "en", None if i % 3 == 0 else "s", 0, 1, True, "r", 2, "k", 3) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", None, None, None, None, None, None, None, None, None)], DOCS)


APPLIED = {
    "license": license.scan,
    "fingerprint": fingerprint.compare_with_edits,
    "positions": fingerprint.fingerprints,
    "quality": quality.judge,
    "substring": substring.deduplicate,
    "mixing": mixing.mix,
    "packing": lambda d: packing.pack_documents(d, queries.tokenizer_path()),
    "sharding": lambda d: sharding.shard_documents(d.select("doc_id", "text", "part", "k")),
    "neardup": neardup.near_duplicates,
    "toxicity": lambda d: toxicity.score(d, toxicity.base_model()),
}


@pytest.mark.parametrize("name", APPLIED)
def test_odd_and_no_rows(spark, name):
    rows = odd(spark)
    assert APPLIED[name](rows.limit(0)).count() == 0
    got = APPLIED[name](rows).collect()
    if name == "packing":
        assert {r["doc_id"] for r in got} == {*range(len(ODD)), None}
    else:
        assert len(got) == len(ODD) + 2


# --- 1 ---


def test_license_forms(spark):
    mit = license.KNOWN[0][1]
    texts = ["Copyright (c) 2020 Someone\n\n" + mit, mit.upper().replace(",", " ,"), "text\nlicenced under the apache licence, version 2.0\nmore", "Released under the MIT License, mostly.", None]
    got = {r["doc_id"]: (r["whole_license"], r["licenses"], r["n_notices"]) for r in license.scan(h.table(spark, texts)).collect()}
    assert got == {0: ("MIT", "MIT", 1 + (got[0][2] - 1)), 1: ("MIT", "MIT", got[1][2]), 2: (None, "Apache-2.0", 1), 3: (None, "", 0), 4: (None, "", 0)}


def test_license_equals_sql(spark, data_dir):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
        wanted = db.execute(f"SELECT doc_id, text_digest, whole_license, licenses, n_notices FROM ({queries.SQL['op1_license_scan']})").fetchall()
    assert sorted(map(tuple, queries.op1_license_scan(spark, data_dir).collect()), key=str) == sorted(wanted, key=str)


MIT_FILE = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_license_files_whole_and_embedded(spark):
    files = {"MIT": MIT_FILE} | {p.stem: p.read_text() for p in license_texts.FOLDER.glob("*.txt") if p.stem != "MIT"}
    files["BSD-3-Clause"] = "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + files["BSD-3-Clause"]
    names = sorted(files)
    texts = [files[n] for n in names] + [f"Some software.\n\n{files[n]}\n\nThat was its licence." for n in names]
    got = {r["doc_id"]: r for r in license.scan(h.table(spark, texts)).collect()}
    assert [got[i]["whole_license"] for i in range(len(names))] == names
    for i, n in enumerate(names):
        inside = got[len(names) + i]
        assert inside["whole_license"] is None and n in inside["licenses"].replace(" OR ", ",").split(",")


def test_a_known_license_text_has_one_id(spark):
    canonical = license.as_one_line(license.canonical_lines(F.col("text")))
    table = spark.createDataFrame(list(license.KNOWN), "id string, text string")
    assert table.groupBy(canonical.alias("c")).agg(F.countDistinct("id").alias("n")).where("n > 1 or c = ''").count() == 0


# --- 2 ---


def labelled(n=400):
    r = random.Random(1)
    fill = lambda k: " ".join(r.choice(["river", "stone", "cloud", "green", "walks", "table"]) for _ in range(k))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        rows.append((i, f"{fill(20)}. you are a blargmost and zonkly{r.randrange(5)} {fill(5)}." if toxic else f"{fill(30)}."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_words_and_beginnings(spark):
    rows, labels = labelled()
    docs = h.table(spark, rows)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.whole.get("blargmost") and model.beginnings.get("zonkly")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    held = {r["doc_id"] for r in docs.where(toxicity.is_held_out(F.col("doc_id"))).select("doc_id").collect()}
    assert held == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(got[i] == t for i, t in labels if i in held)


def test_held_out_labels_are_not_used(spark):
    rows, labels = labelled(100)
    flipped = [(i, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, t) for i, t in labels]
    docs = h.table(spark, rows)
    fit = lambda x: toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, toxic int"))
    assert fit(labels) == fit(flipped)


@pytest.mark.parametrize(("clause", "event"), [("what an idiot", "plain"), ("you idiot", "targeted"), ("idiot that you are", "targeted"), ("he is not an idiot", "negated"), ("she said he is an idiot", "reported"), ('"idiot" is a word', "reported"), ("i will hurt you", "threat"), ("he said, you are an idiot", "reported"), ("don’t call them idiot", "negated"), ('"hello" you idiot', "targeted"), ('"well." you idiot', "targeted")])
def test_clauses(clause, event):
    model, machine = toxicity.base_model(), toxicity.Machine()
    found = dict(zip(toxicity.FEATURES, model.features(clause, machine), strict=True))
    assert {e for e in toxicity.EVENTS if found[e] > 0} - ({"plain"} if event == "targeted" else set()) == {event}
    assert model.score(model.features("a quiet river", machine)) < 0.5


def test_no_threat_without_its_object():
    model, machine = toxicity.base_model(), toxicity.Machine()
    assert not any(model.features("kill the process before you go", machine)[: len(toxicity.EVENTS)])


def test_the_composed_machine_equals_its_parts_side_by_side():
    r, machine = random.Random(9), toxicity.Machine()
    for _ in range(300):
        composed, apart = machine.start, [0] * len(toxicity.PARTS)
        for symbol in (r.randrange(10) for _ in range(30)):
            up = {p.flag for p, s in zip(toxicity.PARTS, apart, strict=True) if s > 0}
            wanted = tuple(e for on, needs, without, e in toxicity.RULES if on == symbol and needs <= up and not without & up)
            composed, events = machine.arc(composed, symbol)
            apart = [p.move(s, symbol) for p, s in zip(toxicity.PARTS, apart, strict=True)]
            assert events == wanted and composed == tuple(apart)


def events_by_looking_back(symbols):
    """The events of one sentence, from the symbols before each one."""
    t, out, said = toxicity, [], 0
    for i, x in enumerate(symbols):
        def near(opener, *ends):
            words = 0
            for y in reversed(symbols[:i]):  # noqa: B023
                if y == opener:
                    return True
                if y == t.BREAK or y in ends:
                    return False
                words += y not in (t.OPEN, t.CLOSE)
                if words >= t.SPAN:
                    return False
            return False

        quiet = said or near(t.NEGATION)
        if x == t.INSULT:
            out.append("reported" if said else "negated" if near(t.NEGATION) else "targeted" if near(t.TARGET) else "plain")
        if x == t.TARGET and not quiet:
            out += ["targeted"] * near(t.INSULT, t.TARGET) + ["threat"] * near(t.THREAT, t.TARGET, t.DETERMINER)
        said = 2 if x == t.OPEN else 0 if x == t.CLOSE and said == 2 else 1 if x == t.REPORT and not said else said
    return out


def test_events_equal_those_found_by_looking_back():
    r, machine = random.Random(10), toxicity.Machine()
    for _ in range(500):
        symbols, state, got = [r.randrange(10) for _ in range(25)], machine.start, []
        for x in symbols:
            state, events = machine.arc(state, x)
            got += events
        assert got == events_by_looking_back(symbols)


def test_skipped_texts_have_no_events():
    class Every(frozenset):
        __contains__ = lambda self, x: True

    quick, full, machine = toxicity.base_model(), toxicity.base_model(), toxicity.Machine()
    full.stems = Every()
    r = random.Random(3)
    parts = ["idiot", "Idiot", "kill", "you", "not", "said", "river", "a", *"\"“(.,;!?-\n ", ",", ".", " "]
    texts = ["well,idiot", "Enough.Idiot", "no;(idiot)", *("".join(r.choice(parts) for _ in range(r.randrange(1, 9))) for _ in range(3000))]
    assert all(any(quick.features(t, machine)) for t in texts[:3])
    assert [quick.features(t, machine) for t in texts] == [full.features(t, machine) for t in texts]


# --- 3 ---


def test_fingerprints_of_neighbours(spark, sample):
    docs, pairs = sample
    got = {r["doc_id"]: r for r in fingerprint.compare_with_edits(docs).collect()}
    order = sorted(pairs, reverse=True)
    for n, (i, t) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), h.sha256(edited))
        assert r["edited_fingerprint"] == fingerprint.as_text(fingerprint.winnow(edited)[0])
        assert r["near_next"] == fingerprint.likeness(fingerprint.winnow(t)[0], fingerprint.winnow(following)[0])
    assert 0.35 < np.mean([r["near_edited"] for r in got.values()]) < 0.65


def test_winnowing_by_hand():
    text = "Abcd efgh, ijkl mnop qrst uvwx yz01 2345 6789 " * 4
    hashes, places = fingerprint.winnow(text, 5, 4)
    kept = [(i, c.lower()) for i, c in enumerate(text) if c.isalnum()]
    grams = {}
    for h1, p in zip(hashes.tolist(), places.tolist(), strict=True):
        at = next(n for n, (i, _) in enumerate(kept) if i == p)
        gram = "".join(c for _, c in kept[at : at + 5])
        assert grams.setdefault(gram, h1) == h1
    at = [next(n for n, (i, _) in enumerate(kept) if i == p) for p in places.tolist()]
    assert at == sorted(at) and max(b - a for a, b in zip(at, at[1:])) <= 4 and at[0] < 4


def test_shared_passages_share_a_fingerprint():
    r = random.Random(2)
    noise = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    passage = noise(fingerprint.K + fingerprint.WINDOW - 1)
    for _ in range(50):
        a, b = (set(fingerprint.winnow(noise(200) + passage + noise(100))[0].tolist()) for _ in range(2))
        assert a & b


@pytest.mark.parametrize("edges", [[], [5], [1, 2, 3], list(range(0, 200, 3)), [-(1 << 63), 0, (1 << 63) - 1]])
def test_edges_below(spark, edges):
    from siltworks.llm.columns import edges_below

    values = sorted({-(1 << 63), -1, 0, 1, 4, 5, 6, 99, 198, 199, (1 << 63) - 1, *edges})
    rows = spark.createDataFrame([(v,) for v in values], "x long").select("x", edges_below(edges, F.col("x")).alias("n")).collect()
    assert [(r["x"], r["n"]) for r in rows] == [(v, sum(e < v for e in edges)) for v in values]


# --- 4 ---


def test_quality_counts(spark, sample):
    docs, pairs = sample
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    for i, t in pairs:
        w, seen, dup = h.words(t), set(), 0
        for line in t.split("\n"):
            dup += line in seen and bool(h.WORD.search(line))
            seen.add(line)
        n = h.repeated_words(w)
        failed = len(w) < 10 or 100 * n > 20 * len(w)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, n, failed)
        assert r["kept"] == verdict(t, failed)[0]


def verdict(text, failed):
    """Whether a text is kept, and the shares of its characters in repeated lines and windows, by looking at every window."""
    w, seen, in_lines = h.words(text), set(), 0
    for line in text.split("\n"):
        in_lines += sum(map(len, h.words(line))) if line in seen else 0
        seen.add(line)
    total, shares = sum(map(len, w)), {}
    for n in quality.LIMITS:
        windows = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)]
        counts = Counter(windows)
        inside = {j + d for j, x in enumerate(windows) if counts[x] > 1 for d in range(n)}
        shares[n] = sum(len(w[j]) for j in inside) / total if total else 0.0
    lines = in_lines / total if total else 0.0
    return not failed and lines <= quality.LINE_LIMIT and all(shares[n] <= limit for n, limit in quality.LIMITS.items()), lines, shares


def test_verdicts_of_repeated_windows_and_lines(spark):
    r = random.Random(7)
    fresh = lambda k: [f"w{r.randrange(10**7)}é" * r.choice([1, 1, 3]) for _ in range(k)]
    texts = []
    for i in range(300):
        again = fresh(r.choice([4, 5, 6, 7, 9, 10, 12]))
        parts = [fresh(r.randrange(5, 60)), again, fresh(r.randrange(5, 40)), again]
        texts.append(r.choice([" ", "\n"]).join(" ".join(x) for x in parts) + r.choice(["", "\n" + " ".join(again)]))
    got = {x["doc_id"]: x for x in quality.judge(h.table(spark, texts)).collect()}
    kinds = Counter()
    for i, t in enumerate(texts):
        kept, lines, shares = verdict(t, got[i]["base_failed"])
        assert got[i]["kept"] == kept and math.isclose(got[i]["line_coverage"], lines)
        assert all(math.isclose(got[i][f"coverage_{n}"], x) for n, x in shares.items())
        kinds[got[i]["base_failed"], kept] += 1
    assert min(kinds[True, False], kinds[False, True], kinds[False, False]) >= 5


# --- 5 ---


def planted(r, n=60):
    """Texts with shared passages, copies and near copies."""
    fresh = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    common, texts = fresh(70), []
    for i in range(n):
        w = fresh(r.choice([5, 49, 50, 120]))
        if r.random() < 0.4:
            at = r.randrange(len(w) + 1)
            w[at:at] = common[r.randrange(10) : 70 - r.randrange(10)]
        if texts and r.random() < 0.3:
            w = texts[r.randrange(len(texts))].split()
            for _ in range(r.choice([0, 0, 1, 3])):
                w[r.randrange(len(w))] = "changed"
        texts.append((" " if r.random() < 0.7 else "\n").join(w))
    return texts + [" ".join(["same"] * 130), " ".join(["same"] * 60)]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_of_planted_passages(spark, seed, monkeypatch):
    monkeypatch.setattr(substring, "GROUP", 300)  # many prefixes, some of them lengthened
    pairs = list(enumerate(planted(random.Random(seed))))
    wanted = h.without_repeats(pairs)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(h.table(spark, pairs)).collect()}
    assert got == {i: (n, m, h.sha256(" ".join(k))) for i, (n, m, k) in wanted.items()}


def test_repeats_in_the_sample(spark, sample):
    docs, pairs = sample
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.deduplicate(docs).collect()}
    assert got == {i: (n, m, h.sha256(" ".join(k))) for i, (n, m, k) in h.without_repeats(pairs).items()}


def test_prefixes_keep_equal_suffixes_together():
    r = np.random.default_rng(0)
    s = r.integers(0, 1 << 63, (2, 5000)).astype(np.uint64)
    s[0, :2500] = s[0, 0]
    first = (s[0] >> np.uint64(52)).astype(int)
    counts = dict(Counter(first.tolist()))
    prefixes = substring.Prefixes(12, counts, 100)
    groups = prefixes.of(s)
    assert prefixes.longer.max() == 5 and 0 <= groups.min() and groups.max() < prefixes.groups
    assert max(Counter(groups.tolist()).values()) <= 150  # 2,500 over 32 lengthened prefixes, the others in runs of 100
    assert (prefixes.of(s[:, ::-1])[::-1] == groups).all()
    assert len(set(prefixes.of(np.repeat(s[:, :1], 9, axis=1)).tolist())) == 1


def test_prefixes_of_one_crowded_passage():
    """Equal suffixes cannot be parted, however many; their neighbours keep groups of their own."""
    s = np.full((2, 3000), 7, np.uint64)
    s[0, 2900:] = np.arange(100, dtype=np.uint64) << np.uint64(57)
    first = substring.first_bits(s, 7)
    groups = substring.Prefixes(7, dict(Counter(first.tolist())), 50).of(s)
    assert len(set(groups[:2900].tolist())) == 1 and len(set(groups[2900:].tolist())) >= 2
    assert substring.Prefixes(3, {}, 50).groups == 1


# --- 6 ---


def test_targets_by_hand():
    assert [float(x) for x in mixing.fill_targets([100, 100, 100], [5, 2, 1], 450)] == [200, 500 / 3, 250 / 3]
    assert [float(x) for x in mixing.fill_targets([10, 1000, 0], [5, 2, 1], 900)] == [20, 880, 0]
    assert mixing.fill_targets([], [], 0) == []


@pytest.mark.parametrize(("sizes", "goal", "sum_"), [([5, 9, 20], 13.5, 14), ([5, 9, 20], 3, 5), ([5], 2, 0), ([], 7, 0), ([3, 3, 3], 9, 9), ([10**9, 3 * 10**9], 3.1e9, 3 * 10**9)])
def test_nearest_subset(sizes, goal, sum_):
    assert sum(sizes[p] for p in mixing.nearest_subset(list(enumerate(sizes)), goal)) == sum_


def test_mix_meets_its_targets(spark):
    r = random.Random(3)
    texts = [" ".join(["w"] * r.choice([1, 10, 50, 400])) for _ in range(900)]
    sources = [None if i % 9 == 0 else f"s{i % 4 if i % 3 else 0}" for i in range(900)]
    docs = h.table(spark, texts, sources)
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id")["taken"].tolist() == again.sort_values("doc_id")["taken"].tolist()
    assert (got["taken"] <= 2 * got["size"]).all() and (got["size"] == [len(texts[i].split()) for i in got["doc_id"]]).all()
    by = got.assign(s=[str(sources[i]) for i in got["doc_id"]]).groupby("s")
    assert ((by["taken"].sum() - by["target"].first()).abs() <= 5).all()
    wanted = mixing.fill_targets([int(x) for x in by["size"].sum()[["s0", "s1", "s2", "s3", "None"]]], [5, 2, 1, 5, 2], 1.5 * got["size"].sum())
    assert np.allclose(by["target"].first()[["s0", "s1", "s2", "s3", "None"]], [float(x) for x in wanted])
    assert mixing.mixed_documents(docs).count() == got["copies"].sum()


def test_taken_documents_are_those_of_least_hashes(spark):
    """Beyond whole copies, a source takes its documents by ascending hash, but for the few around its boundary; no other choice among those comes nearer."""
    r = random.Random(11)
    docs = h.table(spark, [" ".join(["w"] * r.randrange(0, 90)) for _ in range(2500)], [f"s{min(r.randrange(6), 3)}" for _ in range(2500)])
    place = {x["doc_id"]: (x["source"], x["place"] % (1 << 64)) for x in docs.select("doc_id", "source", F.xxhash64("doc_id", "text", F.lit(17)).alias("place")).collect()}
    rows = [x for x in mixing.mix(docs).collect() if x["size"]]
    for source in {s for s, _ in place.values()}:
        mine = sorted((place[x["doc_id"]][1], x["copies"], x["size"]) for x in rows if place[x["doc_id"]][0] == source)
        target, whole = next(x["target"] for x in rows if place[x["doc_id"]][0] == source), min(c for _, c, _ in mine)
        more = [c > whole for _, c, _ in mine]
        assert {c for _, c, _ in mine} <= {whole, whole + 1}
        if any(more) and not all(more):
            first_left, last_taken = more.index(False), len(more) - 1 - more[::-1].index(True)
            assert last_taken - first_left < mixing.FEW
        assert abs(sum(c * n for _, c, n in mine) - target) <= 1


def test_deep_boundaries_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BITS", 2)
    monkeypatch.setattr(mixing, "FEW", 3)
    docs = h.table(spark, [(1, "a b c")] * 50 + [(i, "a b") for i in range(2, 200)])
    got = mixing.mix(docs).toPandas()
    assert abs(got["taken"].sum() - 1.5 * got["size"].sum()) <= 150


# --- 7 ---


def test_packing_of_the_sample(spark, sample):
    from tokenizers import Tokenizer

    docs, pairs = sample
    plain = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack_documents(docs, queries.tokenizer_path()).toPandas().set_index(["doc_id", "piece"])
    total = 0
    for i, t in pairs:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 2]
        total += len(ids)
        for n, (a, b) in enumerate(zip(starts := packing.cut(len(ids), 1024), [*starts[1:], len(ids)], strict=True)):
            r = got.loc[(i, n)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes()))
    flat = got.sort_values(["sequence_id", "offset"])
    assert (flat.groupby("sequence_id")["length"].cumsum() - flat["length"] == flat["offset"]).all()
    assert flat.groupby("sequence_id")["length"].sum().max() <= 1024
    bound = packing.lower_bound(got["length"].to_numpy())
    assert bound <= got["sequence_id"].nunique() <= bound * 1.01 + 1


def test_rounds_of_repacking(spark):
    r = random.Random(4)
    rows = [(i, 0, 0, r.choice([340, 345, 350, 520, 700, 1024, 5]), i) for i in range(2000)]
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), per_partition=150).toPandas()
    assert len(got) == 2000 and got.groupby("sequence_id")["length"].sum().max() <= 1024
    sizes = np.array([x[3] for x in rows])
    assert packing.lower_bound(sizes) <= got["sequence_id"].nunique() <= 1.02 * len(packing.best_fit_decreasing(sizes)[1])


LOOSE = {"300/420": lambda r: r.choice([300, 420]), "280/330/460": lambda r: r.choice([280, 330, 460]), "257-511": lambda r: r.randint(257, 511), "200-500": lambda r: r.randint(200, 500), "ones": lambda r: 1}


@pytest.mark.parametrize("mix", LOOSE)
def test_rounds_end_where_bounds_are_loose(spark, mix):
    r = random.Random(1)
    rows = [(i, 0, 0, LOOSE[mix](r), i) for i in range(6000)]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES), per_partition=1200)
    got, sizes = packed.toPandas(), np.array([x[3] for x in rows])
    assert sorted(got["doc_id"]) == list(range(6000)) and got.groupby("sequence_id")["length"].sum().max() <= 1024
    for _, some in got.sort_values("offset").groupby("sequence_id"):
        assert (some["offset"] == some["length"].cumsum() - some["length"]).all()
    n = got["sequence_id"].nunique()
    assert n <= 1.02 * len(packing.best_fit_decreasing(sizes)[1])
    assert (got["partition_bound"] <= got["partition_sequences"]).all()
    assert tuple(packing.certificate(packed).first()) == (n, packing.lower_bound(sizes)) and packing.lower_bound(sizes) <= n


def test_cuts_and_bounds():
    assert packing.cut(3, 5) == [0] and packing.cut(5, 5) == [0] and packing.cut(11, 5) == [0, 1, 6]
    assert packing.lower_bound(np.array([600] * 10)) == 10 and packing.lower_bound(np.array([342] * 9)) == 5
    for seed in range(5):
        sizes = np.random.default_rng(seed).integers(1, 1024, 300)
        assert packing.lower_bound(sizes) <= len(packing.best_fit_decreasing(sizes)[1])


@pytest.mark.parametrize("text", ["", " ", "  a  b", "a \n b\n  c  ", "it's  x\t y", "<|endoftext|> z", "é𝄞 ,. 12 345 ", "a" * 500])
def test_ids_equal_those_of_tokenizers(text):
    e = packing.encoder(queries.tokenizer_path())
    assert e.encode(text) == np.asarray(e.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# --- 8 ---


@pytest.mark.parametrize("shards", [24, 5, 1])
def test_shards_hold_near_equal_bytes(spark, shards):
    r = random.Random(5)
    texts = ["x" * r.choice([1, 10, 200, 900]) + str(i % 1500) for i in range(3000)] + ["hot" * 50] * 1500
    got = sharding.shard_documents(h.table(spark, texts), shards=shards).toPandas()
    assert len(got) == 4500 and (got["size"] == got["text"].map(lambda t: len(t) + 8)).all() and (got["text_crc32"] == got["text"].map(lambda t: zlib.crc32(t.encode()))).all()
    by = got.groupby("shard")
    assert len(by) == shards and (by["size"].sum() - got["size"].sum() / shards).abs().max() <= 0.02 * got["size"].sum() / shards + 950
    assert all(sorted(x) == list(range(len(x))) for _, x in by["slot"])


@pytest.mark.parametrize("shards", [24, 7])
def test_equal_texts_share_a_shard(spark, shards):
    r = random.Random(8)
    texts = [f"text {r.randrange(50)} " * 20 for _ in range(2000)] + ["the hottest " * 9] * 900 + [None, ""] * 30
    got = sharding.shard_documents(h.table(spark, texts), shards=shards).toPandas()
    got["text"] = got["text"].fillna("")
    hot = got["text"] == "the hottest " * 9
    assert len(got) == len(texts) and (got[~hot].groupby("text")["shard"].nunique() == 1).all()
    assert all(sorted(x) == list(range(len(x))) for _, x in got.groupby("shard")["slot"])
    by, mean = got.groupby("shard")["size"].sum(), got["size"].sum() / shards
    heaviest = got[~hot].groupby("text")["size"].sum().max()
    assert len(by) == shards and (by - mean).abs().max() <= heaviest
    assert got[hot]["shard"].nunique() <= math.ceil(got[hot]["size"].sum() / mean)  # divided only as far as it must be


# --- 9 ---


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_of_planted_copies(spark, seed, monkeypatch):
    monkeypatch.setattr(neardup, "LARGE", 6)  # the family below takes the way of large buckets
    monkeypatch.setattr(neardup, "BLOCK", 8)
    r = random.Random(seed)
    fresh = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    base, texts = fresh(150), ["", None, "a", "A", "a b"]
    for _ in range(40):
        w = list(base)
        for _ in range(r.randrange(9)):
            w[r.randrange(len(w))] = f"x{r.randrange(99)}"
        texts.append(" ".join(w))
    for _ in range(40):
        w = fresh(r.choice([3, 6, 40, 200]))
        texts += [" ".join(w), " ".join(w).upper() + "\n", " ".join(w[: r.randrange(len(w)) + 1])]
    pairs = list(enumerate(texts))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(h.table(spark, pairs)).collect()}
    assert got == h.near_components(pairs)


def test_words_that_differ_beyond_their_first_bytes_differ(spark):
    a, b = "a" * 4096, "b" * 4096
    docs = h.table(spark, [a + b, b + a, *(" ".join([x, *(f"w{i}" for i in range(60))]) for x in (a + b, b + a))])
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs).collect()} == {0: 0, 1: 1, 2: 2, 3: 2}
    docs = h.table(spark, [" ".join([*(f"w{i}" for i in range(30)), x, *(f"v{i}" for i in range(30))]) for x in (a + b, b + a)])
    assert [r["n_removed"] for r in substring.deduplicate(docs).collect()] == [0, 0]


def test_near_duplicates_of_the_sample(spark, sample):
    docs, pairs = sample
    wanted = h.near_components(pairs)
    got = neardup.near_duplicates(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == wanted
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert sorted(r["doc_id"] for r in neardup.one_of_each_group(docs).collect()) == sorted(i for i, (_, c) in wanted.items() if i == c)


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 1 << 63, 800).astype(np.uint64)) for _ in range(2))
    both = np.unique(np.concatenate([a[:600], b]))
    assert (np.maximum(neardup.registers(a), neardup.registers(b)) == neardup.registers(np.union1d(a, b))).all()
    x, y = neardup.registers(a), neardup.registers(np.concatenate([a[:700], b[:100]]))
    found = neardup.likeliest(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([800.0]), np.array([800.0]))[0]
    assert abs(found - 700 / 900) < 0.15 and len(both)


@pytest.mark.parametrize(("percent", "block"), [(50, 2048), (50, 4), (60, 2048), (90, 2048)])
def test_near_duplicates_at_other_thresholds(spark, percent, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", block)
    r, texts = random.Random(percent), []
    fresh = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    for _ in range(12):  # the first part of a text: the share of common shingles is that of the sizes
        w = fresh(204)
        texts += [" ".join(w[: 4 + round(200 * share)]) for share in (1, percent / 100 + 0.02)]
        texts += [" ".join(w[:100] + fresh(20) + w[100:])]
    family = fresh(154)  # neighbours have a share of shingles near the threshold
    texts += [" ".join(family[: 4 + round(150 * (percent / 100 + 0.04) ** k)]) for k in range(4)]
    pairs = list(enumerate(texts))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(h.table(spark, pairs), percent=percent).collect()}
    assert got == h.near_components(pairs, percent)


def test_limits_follow_the_threshold():
    n = neardup.REGISTERS
    for percent in range(5, 101):
        x, at = neardup.limits(percent), percent / 100
        below = lambda share: sum(math.comb(n, k) * at**k * (1 - at) ** (n - k) for k in range(math.ceil(share * n)))  # noqa: B023, E731
        assert max(below(x.estimate), below(x.equal)) < 1e-6 and (1 - at**x.band) ** x.bands < 6e-6 and x.band * x.bands <= n
    with pytest.raises(ValueError):
        neardup.limits(4)


def test_estimates_miss_fewer_links_than_bands():
    at, n = neardup.PERCENT / 100, neardup.REGISTERS
    below = lambda share: sum(math.comb(n, k) * at**k * (1 - at) ** (n - k) for k in range(math.ceil(share * n)))
    assert below(neardup.ESTIMATE) + below(neardup.EQUAL) < 1e-6 < (1 - at**neardup.BAND) ** neardup.BANDS


# --- 10 ---


def conversations(r, n=30):
    odd_texts = [None, "", "</s>[INST] ok [/INST]", "<\\\\s> <\\/s> <|x|>", "a\nb</s><s>user\n", "é 𝄞 " * 30, "word " * 400]
    rows = []
    for c in range(n):
        roles = (["system"] if c % 2 else []) + [r.choice(["user", "assistant", "assistant", "tool<x\n%"]) for _ in range(r.randrange(1, 14))]
        rows += [(c, i, role, r.choice(odd_texts)) for i, role in enumerate(roles)]
    return [*rows, (99, None, "user", "no turn"), (99, None, "assistant", "no turn"), (None, 0, "assistant", "no conversation"), (7, 3000, None, "late")]


@pytest.mark.parametrize(("budget", "history"), [(chat.BUDGET, chat.HISTORY), (40, 20), (10, 0)])
def test_chat_reads_back(spark, budget, history):
    rows = conversations(random.Random(6))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(df, budget=budget, history=history)
    got = {r["conv_id"]: r for r in chat.read_back(windows).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is None, turn or 0, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), h.sha256(said), len(loss), h.sha256(loss)), c
    assert len(got) == len(by)
    text = windows.select("formatted", "n_turns").collect()
    assert all(w["formatted"].count("</s>") == w["n_turns"] == w["formatted"].count("<s>") and "[INST]" not in w["formatted"] for w in text)
    for w in windows.select("tokens", "repeated", "n_turns").collect():
        assert w["tokens"] <= budget or (w["n_turns"], w["repeated"]) == (1, 0)
    if budget == 40:
        assert any(w["repeated"] > 1 for w in windows.select("repeated").collect())


def test_windows_of_a_long_conversation_keep_the_budget(spark):
    rows = [(1, i, "system" if not i else ("user", "assistant")[i % 2], "w " * (60 if not i else (300, 40, 700, 5, 5, 2000)[i % 6])) for i in range(2500)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "conv_id long, turn long, role string, text string, span string, nth int, tokens string")
    windows = chat.format_windows(df).orderBy("span").collect()
    size = lambda w: w["formatted"].count("w ") + 4 * w["n_turns"]
    assert all(size(w) == w["tokens"] and (w["tokens"] <= chat.BUDGET or (w["n_turns"], w["repeated"]) == (1, 0)) for w in windows)
    assert sum(w["n_turns"] - w["repeated"] for w in windows) == len(rows)
    whole = [w for w in windows[1:] if w["tokens"] <= chat.BUDGET]
    assert all(w["formatted"].startswith("<s>system") for w in whole if w["tokens"] > 300) and sum(w["tokens"] for w in whole) > 0.4 * chat.BUDGET * len(whole)


def test_no_conversation(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_texts_of_one_hash_are_no_copies(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, 5, a, 1), (2, 5, b, 2), (3, 5, a, 1)]  # all of one hash; the second hash tells them apart
    found = substring.redundant_windows(spark.createDataFrame(rows, "rank long, text_hash long, text string, check long")).collect()
    assert [(r["rank"], r["copy"], r["starts"]) for r in found] == [(3, True, None)]
