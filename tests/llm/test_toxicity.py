"""Scores of clauses: a plain restatement of the grammar, and a fitted model on negated and reported insults."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltworks.llm import toxicity
from tests.llm import helpers as h

FILL = ["river", "stone", "cloud", "green", "walks", "table"]
VERBS = {"hurt", "kill"}


def plain_features(text, model):
    """Looks back over the words of a sentence instead of running a machine; for texts without quotes."""
    sums, matched, clauses, words_hit = dict.fromkeys(toxicity.EVENTS, 0.0), 0, 0, set()
    for sentence in re.split(r"[.!?\n]+", text):
        reported = False
        for clause in re.split(r"[;,]+", sentence):
            words, negated, hit = clause.split(), [], False
            clauses += bool(words)
            open_until = -1  # last place that a negation reaches
            for i, w in enumerate(words):
                negated.append(i <= open_until)
                if w in toxicity.NEGATIONS or negated[i] and (w in toxicity.INSULTS or w in VERBS):
                    open_until = i + toxicity.SPAN
                recent = [k for k in range(max(0, i - toxicity.SPAN), i)]
                events = []
                if w in toxicity.INSULTS:
                    kind = "reported" if reported else "negated" if negated[i] else "targeted" if any(words[k] in toxicity.TARGETS for k in recent) else "plain"
                    events = [(kind, w)]
                elif w in toxicity.TARGETS and not reported and not negated[i]:
                    for kind, openers, enders in (("targeted", toxicity.INSULTS, toxicity.TARGETS), ("threat", VERBS, (*toxicity.TARGETS, *toxicity.DETERMINERS))):
                        last = next((k for k in reversed(recent) if words[k] in openers or words[k] in enders), None)
                        if last is not None and words[last] in openers:
                            events.append((kind, None))
                for kind, word in events:
                    sums[kind] += 1.0
                    if kind in toxicity.RAISING:
                        hit = True
                        words_hit.add(word or next(words[k] for k in reversed(range(i)) if words[k] in toxicity.INSULTS or words[k] in VERBS))
                reported = reported or w in toxicity.REPORTS
            matched += hit
    return [*[math.log1p(sums[e]) for e in toxicity.EVENTS], math.log1p(matched), math.log1p(len(words_hit)), matched / clauses if matched else 0.0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "moron", "hurt", "you", "she", "not", "never", "said", "the", "river", "stone", "a", ",", ";", ".", "!", "\n"]), max_size=40))
def test_features_equal_a_plain_restatement(words):
    text, model = " ".join(words), toxicity.base_model()
    assert model.features(text, toxicity.Machine()) == pytest.approx(plain_features(text, model))


def sentences(r, kind):
    insult, verb = r.choice(toxicity.INSULTS[:8]), r.choice(["hurt", "kill"])
    fill = lambda k: " ".join(r.choice(FILL) for _ in range(k))
    forms = {
        "plain": [f"what an {insult} {fill(3)}", f"you are an {insult}", f"they will {verb} you"],
        "negated": [f"you are not an {insult}", f"he was never {insult} {fill(2)}", f"nobody will {verb} you"],
        "reported": [f"she said you are an {insult}", f'"{insult}" is what {fill(2)} means', f"he wrote that they are {insult} {fill(1)}"],
    }
    return r.choice(forms[kind])


def generated(seed, n, kinds):
    r = random.Random(seed)
    fill = lambda: " ".join(r.choice(FILL) for _ in range(12))
    return [(i, f"{fill()}. {sentences(r, kinds[i % len(kinds)])}. {fill()}.", int(kinds[i % len(kinds)] == "plain")) for i in range(n)]


@pytest.fixture(scope="module")
def fitted(spark):
    rows = generated(1, 300, ["plain", "negated", "reported"])
    return toxicity.fit(h.table(spark, [x[:2] for x in rows]), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int"))


def test_negated_and_reported_insults_never_raise_a_score(fitted):
    machine, r = toxicity.Machine(), random.Random(3)
    for i, text, _ in generated(2, 120, ["plain", "negated", "reported"]):
        before = fitted.score(fitted.features(text, machine))
        added = sentences(r, ("negated", "reported")[i % 2])
        for longer in (f"{text} {added}.", f"{added}. {text}"):
            assert fitted.score(fitted.features(longer, machine)) <= before + 1e-12
    nothing = fitted.score(fitted.features("", machine))
    for said in ("you are not an idiot.", "She said you are an idiot.", "He is never stupid, not an idiot, no loser.", '"idiot" you'):
        assert fitted.score(fitted.features(said, machine)) <= nothing < 0.5 < fitted.score(fitted.features("you idiot", machine))


def test_the_grammar_tells_what_word_counts_cannot(fitted):
    machine, held_out = toxicity.Machine(), generated(9, 150, ["plain", "negated", "reported"])
    got = [(fitted.score(fitted.features(t, machine)) >= 0.5, y) for _, t, y in held_out]
    by_words = [(any(w.strip('".,') in toxicity.INSULTS or w in VERBS for w in t.split()), y) for _, t, y in held_out]
    right = lambda rows: sum(a == bool(b) for a, b in rows) / len(rows)
    assert right(got) > 0.95 > 0.5 > right(by_words)
