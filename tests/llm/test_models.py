"""Languages and toxicity against slow versions of their methods."""

import math

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from entigraph.llm import language_id, toxicity


def slow_counts(text):
    """Bigrams and trigrams of letters and word ends, hashed one by one."""
    codes = [32]
    for c in (text or "").lower():
        if regex.match(r"\p{L}", c):
            codes.append(ord(c))
        elif codes[-1] != 32:
            codes.append(32)
    if codes[-1] != 32:
        codes.append(32)
    out = [0] * language_id.FEATURES
    for n in (2, 3):
        for k in range(len(codes) - n + 1):
            h = 2166136261 + n
            for c in codes[k : k + n]:
                h = (h ^ c) * 16777619 % (1 << 32)
                h ^= h >> 15
            out[h % language_id.FEATURES] += 1
    return out


def slow_predict(model, text):
    raw = slow_counts(text)
    if not regex.search(r"\p{L}", text or ""):
        return language_id.UNKNOWN, 0.0, True
    v = [math.log(1 + n) * float(w) for n, w in zip(raw, model.weights)]
    norm = math.sqrt(math.fsum(x * x for x in v)) or 1.0
    cosines = [math.fsum(x * float(y) for x, y in zip(v, c)) / norm for c in model.centroids]
    best = max(range(len(cosines)), key=cosines.__getitem__)
    share = math.sqrt(min(language_id.WHOLE, max(1, sum(n > 0 for n in raw))) / language_id.WHOLE)
    return model.languages[model.owner[best]], cosines[best], cosines[best] < model.least[model.owner[best]] * share


def test_predictions_against_a_slow_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = language_id.fit(docs, language_id.remainder(F.col("doc_id"), 3) != 1)
    got = {r.doc_id: r for r in language_id.identified(docs).collect()}
    for r in docs.collect()[::7]:
        lang, score, rejected = slow_predict(model, r.text)
        assert (got[r.doc_id].lang_pred, got[r.doc_id].rejected) == (lang, rejected) and abs(got[r.doc_id].score - score) < 1e-4
    texts = [None, "", "12 !", "é", "a b", "the house " * 3000, "Ünïcödé 中文 words"]
    for text, lang, score, rejected in zip(texts, *model.predict(texts)):
        want = slow_predict(model, text)
        assert (lang, rejected) == (want[0], want[2]) and abs(score - want[1]) < 1e-4


def test_the_sample_is_bounded_and_even(spark, monkeypatch):
    monkeypatch.setattr(language_id, "PER_LANGUAGE", 20)
    rows = [(k, "the house of the sea ", "en") for k in range(3000)] + [(5000 + k, "das haus am meer ", "de") for k in range(40)] + [(7, "the house", "en")] * 200
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, lang string, _key int, _sampled string")
    model = language_id.fit(docs, F.lit(True))
    assert model.languages == ["de", "en"] and set(model.owner.tolist()) == {0, 1}
    assert model.predict(["the sea of the house", "das meer am haus"])[0] == ["en", "de"]


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(k, "same words here", lang) for k, lang in enumerate(["xx", "aa", "mm"] * 4)], "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True))
    assert model.predict(["same words here"])[0] == ["aa"]


def slow_restore(model, span):
    """Every path through the lattice, one by one: the letters of the cheapest."""
    best = (math.inf, "")
    fold = toxicity._folded()

    def cost(a, b, x):
        return float(model.costs[(a * 28 + b) * 28 + x])

    def walk(k, a, b, total, letters):
        nonlocal best
        if k == len(span):
            end = total + cost(a, b, 0)
            if end < best[0]:
                best = (end, letters)
            return
        c, s = span[k], int(fold[ord(span[k])])
        arcs = [(s, toxicity._COST["plain"])] if s else [(ord(x) - 96, toxicity._COST["sign"]) for x in toxicity.LOOKS_LIKE.get(c, "")]
        for x, more in arcs:
            walk(k + 1, b, x, total + more + cost(a, b, x), letters + ("?" if x == 27 else chr(96 + x)))
            if x == b:
                walk(k + 1, a, b, total + toxicity._COST["repeat"], letters)
        if not s and (not arcs or not c.isalnum()):
            usual = c in toxicity._SEPARATORS or not arcs
            walk(k + 1, a, b, total + toxicity._COST["separator" if usual else "sign"], letters)
            if b:
                walk(k + 1, 0, 0, total + toxicity._COST["plain" if usual else "sign"] + cost(a, b, 0), letters + " ")

    walk(0, 0, 0, 0.0, "")
    return best[1]


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(2)
    trigrams = toxicity.trigram_counts(["the idle river runs by an old mill and she reads a dotted book"] * 3) + rng.integers(0, 2, 28**3)
    weights = {"idiot": 3.0, "moron": 2.0, "foo*": 1.5}
    return toxicity.Model(weights, {"moron": 0.99}, -4.0, toxicity.language_model(trigrams, {"idiot": 5, "moron": 3, "foo*": 4}))


def test_decoding_against_every_path(model):
    rng = np.random.default_rng(0)
    alphabet = list("idotmrn1!0@3. -_+é中|")
    for span in ["1d10t", "i.d.i.o.t", "iidd", "m0r0n", "f00l", "!d|ot", *("".join(rng.choice(alphabet, rng.integers(1, 8))) for _ in range(300))]:
        assert model.restore(span) == slow_restore(model, span), span


def test_scores_come_through_the_channel_at_every_level(model):
    """A disguised word adds to a text that is toxic by its plain words already."""
    assert model.score("idiot") >= 0.02
    assert model.score("moron 1d10t") > model.score("moron") and model.score("idiot m0r0n") > model.score("idiot")
    both = model.probability({"idiot", "moron"})
    assert abs(model.score("1d10t m0r0n") - both) < 1e-12 and abs(model.score("idiot moron") - both) < 1e-12
