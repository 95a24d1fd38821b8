"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer turns words into classes (insult, threat, target, negation, report, determiner) and weights; quotes and clause and
sentence ends are symbols too. Five small transducers read these symbols, each with a flag that is up while it is active: negation (for
a few words after a negation, within its clause), reported speech (from a reporting verb to the sentence's end, or between quotes), target
(a person named shortly before), insult (a target may still follow it) and threat (a threatening verb whose object, unless a determiner begins it, may follow).
`Machine` composes them to one deterministic machine, built arc by arc as needed, and RULES turn its flags into matched events: an insult's
weight together with whether it is targeted, negated or reported, or a threat. What raises a score are the matched clauses: the weights, the clauses and the
words of plain, targeted and threatening events, all with weights of 0 or more. Negated and reported insults have features of their own, with weights of 0 or
less; they count in no other, so adding such a clause never raises a score.

The lexicon has a fixed part and a part induced from labelled rows: whole words and beginnings of words that occur in a much larger share
of the toxic documents than of the others. The weights of the events come from a logistic regression on the same rows. Both
use at most SAMPLE labelled rows, those with the least hash of the id; labels, ids and other columns are no inputs of a score.

Defined results: null and empty texts get the score of a text without events; repeated rows get equal scores; labelled rows with a null id or
label are not used, and of repeated labels the greatest counts; without rows of both labels fixed weights apply; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltworks.session import arrow_rows, settle

#: Labelled rows that the model may learn from, at most.
SAMPLE = 20_000
FOLDS = 5
#: Beginnings of words that may enter the induced lexicon, and how many candidates are counted.
PATTERNS, CANDIDATES = 400, 20_000
SPAN = 4

# Words of the classes, in English, French, German and Spanish.
INSULTS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "fool", "dumb", "jerk", "vermin", "crétin", "débile", "ordure", "connard", "minable", "dummkopf", "trottel", "abschaum", "idiotin", "versager", "idiota", "imbécil", "estúpido", "basura", "asqueroso")
THREATS = ("kill", "hurt", "destroy", "beat", "crush", "shoot", "burn", "tuer", "détruire", "frapper", "töten", "zerstören", "schlagen", "matar", "destruir", "golpear")
TARGETS = ("you", "your", "yours", "he", "she", "him", "her", "they", "them", "tu", "toi", "vous", "lui", "elle", "du", "dich", "dir", "sie", "ihn", "ihr", "tú", "ti", "usted", "ustedes", "ella", "ellos")
NEGATIONS = ("not", "no", "never", "nobody", "isn't", "aren't", "don't", "won't", "pas", "jamais", "ne", "nicht", "nie", "kein", "keine", "nunca", "jamás", "ni")
REPORTS = ("said", "says", "say", "wrote", "writes", "called", "calls", "claimed", "claims", "quoted", "quotes", "reported", "dit", "écrit", "sagte", "schrieb", "behauptet", "dijo", "dice", "escribió")

DETERMINERS = ("the", "a", "an", "this", "that", "these", "those", "le", "les", "un", "une", "der", "die", "das", "den", "einen", "eine", "el", "los", "las", "una")

INSULT, THREAT, TARGET, NEGATION, REPORT, DETERMINER, OTHER, OPEN, CLOSE, BREAK = range(10)
_CLAUSE = re.compile(r"[.!?;,\n]+")
_SENTENCE = re.compile(r"[.!?\n][.!?;,\n]*")
_PAUSE = re.compile(r"[;,]+")
_EDGES = "\"'“”„«»()[]{}<>*#$%&|:!?.,;-_/\\"
_OPENING, _CLOSING = ("\"", "“", "„", "«"), ("\"", "”", "“", "»")

EVENTS = ("plain", "targeted", "negated", "reported", "threat")
RAISING, NEVER_RAISE = ("plain", "targeted", "threat"), ("negated", "reported")
#: Of clauses with a raising event: their number, their different words, their share.
FEATURES = (*EVENTS, "clauses", "distinct", "density")
#: Words whose class is remembered.
MEMORY = 500_000


class Transducer(NamedTuple):
    """States are small numbers, 0 at the start; the flag is up in all others. A move gives the state after a symbol."""

    flag: str
    move: Callable[[int, int], int]


def within_reach(flag: str, opener: int, *ends: int) -> Transducer:
    """Active for SPAN words after the opener, unless one of the other symbols or a clause's end comes before."""

    def move(state: int, symbol: int) -> int:
        if symbol == opener:
            return SPAN
        if symbol in ends or symbol == BREAK:
            return 0
        return state if symbol in (OPEN, CLOSE) else max(0, state - 1)

    return Transducer(flag, move)


def _speech(state: int, symbol: int) -> int:
    """1 after a reporting verb, 2 between quotes; the end of a quote ends both."""
    if symbol == OPEN:
        return 2
    if symbol == CLOSE and state == 2:
        return 0
    return max(state, 1) if symbol == REPORT else state


def _negation(state: int, symbol: int) -> int:
    """As within reach of a negation; a negated insult keeps it up for as long as a target may follow the insult."""
    return SPAN if state and symbol in (INSULT, THREAT) else within_reach("", NEGATION).move(state, symbol)


PARTS = (
    Transducer("negated", _negation),
    Transducer("reported", _speech),
    within_reach("target", TARGET),
    within_reach("insult", INSULT, TARGET, CLOSE),
    within_reach("threat", THREAT, TARGET, DETERMINER, CLOSE),
)
#: Symbol, flags that must be up, flags that must be down, event. The flags are those before the symbol.
RULES = (
    (INSULT, {"reported"}, set(), "reported"),
    (INSULT, {"negated"}, {"reported"}, "negated"),
    (INSULT, {"target"}, {"reported", "negated"}, "targeted"),
    (INSULT, set(), {"reported", "negated", "target"}, "plain"),
    (TARGET, {"insult"}, {"reported", "negated"}, "targeted"),
    (TARGET, {"threat"}, {"reported", "negated"}, "threat"),
)


class Machine:
    """The composition of transducers: a state is the tuple of theirs, an arc's events follow from the flags by the rules."""

    def __init__(self, parts: tuple[Transducer, ...] = PARTS, rules=RULES):
        self.parts, self.rules, self.start = parts, rules, (0,) * len(parts)
        self.arcs: dict = {}

    def arc(self, state: tuple, symbol: int) -> tuple[tuple, tuple[str, ...]]:
        """Next state and events of reading a symbol; events carry the weight of the insult at hand or before."""
        known = self.arcs.get((state, symbol))
        if known is None:
            up = {p.flag for p, s in zip(self.parts, state, strict=True) if s}
            events = tuple(event for on, needs, without, event in self.rules if on == symbol and needs <= up and not without & up)
            known = self.arcs[state, symbol] = tuple(p.move(s, symbol) for p, s in zip(self.parts, state, strict=True)), events
        return known


@dataclass
class Model:
    """Everything that a score depends on; small, whatever the corpus."""

    whole: dict[str, float]
    beginnings: dict[str, float]
    bias: float = -3.0
    weights: tuple[float, ...] = (1.2, 2.0, 0.0, 0.0, 1.5, 0.8, 0.8, 2.0)
    center: tuple[float, ...] = (0.0,) * len(FEATURES)
    scale: tuple[float, ...] = (1.0,) * len(FEATURES)
    classes: dict[str, int] = field(init=False, repr=False)
    known: set = field(init=False, repr=False, compare=False)
    hot: set = field(init=False, repr=False, compare=False)
    lengths: tuple[int, ...] = field(init=False, repr=False)

    def __post_init__(self):
        self.classes = {w: c for c, words in ((DETERMINER, DETERMINERS), (REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (THREAT, THREATS)) for w in words}
        self.lengths = tuple(sorted({len(b) for b in self.beginnings}, reverse=True))
        self.known, self.hot = set(), set()

    def insult(self, word: str) -> float | None:
        if self.classes.get(word, THREAT) != THREAT:
            return None  # a word of the grammar
        weight = self.whole.get(word)
        if weight is None:
            for n in self.lengths:
                weight = self.beginnings.get(word[:n]) if len(word) > n else None
                if weight is not None:
                    break
        return weight

    def may_match(self, words: set[str]) -> bool:
        """Whether an insult or threat is among raw words; classes of words are remembered."""
        if len(self.known) > MEMORY:
            self.known.clear()
            self.hot.clear()
        for raw in words - self.known:
            word = raw.strip(_EDGES)
            if self.classes.get(word) == THREAT or self.insult(word) is not None:
                self.hot.add(raw)
        self.known |= words
        return not self.hot.isdisjoint(words)

    def features(self, text: str, machine: Machine) -> list[float]:
        text = text.lower().replace("’", "'")
        if not self.may_match(set(_CLAUSE.sub(" ", text).split())):
            return [0.0] * len(FEATURES)
        sums = dict.fromkeys(EVENTS, 0.0)
        matched = clauses = 0
        distinct: set[str] = set()
        for sentence in _SENTENCE.split(text):
            parts = [p for c in _PAUSE.split(sentence) if (p := c.split())]
            clauses += len(parts)
            if self.hot.isdisjoint(w for words in parts for w in words):
                continue
            state, held, said = machine.start, 0.0, ""
            for number, words in enumerate(parts):
                if number:
                    state = machine.arc(state, BREAK)[0]
                hit = False
                for raw in words:
                    word = raw.strip(_EDGES)
                    if raw[0] in _OPENING and raw != '"':  # a straight quote that stands alone ends speech
                        state, _ = machine.arc(state, OPEN)
                    symbol = self.classes.get(word, OTHER)
                    weight = self.insult(word) if raw in self.hot else None
                    if weight is not None:
                        symbol, held, said = INSULT, weight, word
                    elif symbol == THREAT:
                        said = word
                    state, events = machine.arc(state, symbol)
                    for event in events:
                        sums[event] += 1.0 if event == "threat" else held
                        if event in RAISING:
                            hit = True
                            distinct.add(said)
                    if raw[-1] in _CLOSING:
                        state, _ = machine.arc(state, CLOSE)
                matched += hit
        found = [math.log1p(max(0.0, sums[e])) for e in EVENTS]
        return [*found, math.log1p(matched), math.log1p(len(distinct)), matched / clauses if matched else 0.0]

    def score(self, features: list[float]) -> float:
        z = self.bias + sum(w * (x - c) / s for w, x, c, s in zip(self.weights, features, self.center, self.scale, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def base_model() -> Model:
    return Model({w: 1.0 for w in INSULTS}, {})


def is_held_out(id_column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def _words(text: str) -> set[str]:
    return {w for w in (x.strip(_EDGES) for x in text.lower().split()) if len(w) >= 3}


def _marks(text: str) -> set[str]:
    """Whole words, with a final blank, and beginnings of words."""
    words = _words(text)
    return {w + " " for w in words} | {w[:n] for w in words for n in range(3, min(len(w), 12) + 1)}


def _count_marks(only: frozenset | None):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                marks = _marks(text or "")
                counts.update(marks if only is None else marks & only)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["mark", "n"])

    return count


def _induced(sample: DataFrame, n1: int, n0: int) -> tuple[dict[str, float], dict[str, float]]:
    least = max(5, math.ceil(0.01 * n1))
    text = F.col("text")
    counted = sample.where("toxic = 1").select(text).mapInArrow(_count_marks(None), "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    df1 = {r["mark"]: r["n"] for r in counted.where(F.col("n") >= least).orderBy(F.desc("n"), "mark").limit(CANDIDATES).collect()}
    counted = sample.where("toxic = 0").select(text).mapInArrow(_count_marks(frozenset(df1)), "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n"))
    df0 = {r["mark"]: r["n"] for r in counted.collect()}
    lift = {m: math.log((n + 0.5) / (n1 + 1)) - math.log((df0.get(m, 0) + 0.5) / (n0 + 1)) for m, n in df1.items()}
    good = {m: x for m, x in lift.items() if x >= 2.0}
    children: dict[str, list[str]] = {}
    for m in good:
        children.setdefault(m[:-1], []).append(m)
    kept: dict[str, float] = {}
    for m in sorted(good, key=lambda m: (len(m), m)):
        if any(df1[c] >= 0.9 * df1[m] for c in children.get(m, ())):
            continue  # a longer mark says as much
        above = max((kept[m[:n]] for n in range(3, len(m)) if m[:n] in kept), default=None)
        if above is None or good[m] >= above + 1.0:
            kept[m] = good[m]
    kept = dict(sorted(kept.items(), key=lambda x: (-x[1] * math.sqrt(df1[x[0]]), x[0]))[:PATTERNS])
    return {m[:-1]: x / 4 for m, x in kept.items() if m[-1] == " "}, {m: x / 4 for m, x in kept.items() if m[-1] != " "}


def _regress(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; the first column is the constant and is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (y - p) - shrink * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink), gradient)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    arrow_rows(spark)
    label = F.col(f"`{label_col}`").cast("int")
    usable = labels.select(F.col(f"`{id_col}`").alias("id"), label.alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isin(0, 1) & ~is_held_out(F.col("id")))
    chosen = usable.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = settle(rows.groupBy("id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return base_model()
    whole, beginnings = _induced(rows, n[1], n[0])
    model = Model({**{w: 1.0 for w in INSULTS}, **whole}, beginnings)
    table = rows.select(F.col("toxic"), F.col("text")).mapInArrow(_featured(model), "toxic int, features array<double>").collect()
    x, y = np.array([r["features"] for r in table]), np.array([r["toxic"] for r in table], float)
    order = np.lexsort((*x.T, y))  # sums of floats in one order, so that runs agree
    x, y = x[order], y[order]
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    table = np.column_stack([np.ones(len(y)), (x - center) / scale])
    used = np.ones(table.shape[1], bool)
    may_not_raise = np.array([False, *[f in NEVER_RAISE for f in FEATURES]])
    while True:  # features of the wrong sign count for nothing
        w = np.zeros(len(used))
        w[used] = _regress(table[:, used], y)
        wrong = np.where(may_not_raise, w > 0, w < 0)
        wrong[0] = False
        if not wrong.any():
            break
        used[wrong] = False
    return Model(model.whole, model.beginnings, float(w[0]), tuple(map(float, w[1:])), tuple(map(float, center)), tuple(map(float, scale)))


def _featured(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()
        for batch in batches:
            found = [model.features(t or "", machine) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["toxic", "features"])

    return rows


def _scored(model: Model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine()
        for batch in batches:
            scores = [model.score(model.features(t or "", machine)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row", "score"])

    return rows


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, score, predicted and the columns named in carry."""
    arrow_rows(docs.sparkSession)
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else [F.struct(F.lit(0).alias("none")).alias("carried")]
    row = F.struct(F.col(f"`{id_col}`").alias("doc_id"), *carried).alias("row")
    packed = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))
    out = packed.mapInArrow(_scored(model), f"row {packed.schema['row'].dataType.simpleString()}, score double")
    return out.select(F.col("row.doc_id").alias("doc_id"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(f"row.carried.`{c}`").alias(c) for c in carry])
