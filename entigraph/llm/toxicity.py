"""Toxicity by noisy-channel deobfuscation.

A classifier over words and word beginnings is learned from labelled documents.
A text is scored by the features that it holds, in plain sight or after
restoration: spans that look disguised (anything but letters among letters, words
of one or two letters in a row, signs between them or not, letters repeated)
become lattices in which a character may stand for
itself or for the letters that it is commonly written for, a separator may be
nothing or a word's end, and a repetition may be one letter.  Viterbi decoding finds the most
likely letters under a character trigram model with a cost for each disguise.
A span whose lattice has no path through any strong feature isn't decoded.

The language model counts the trigrams of all documents, plus the words of the
strong features, since the channel hides those.  The classifier is a logistic
regression fitted on at most ``SAMPLE`` labelled rows, those with the smallest
hash of their id.  Its features are words and beginnings that toxic documents
hold more often than others do, seen after several different words (words of
copied texts aren't), and beginnings that two different words share.

Defined results: null and empty texts have no features; a document labelled
twice is toxic if any label is; labels without a document, null labels and null
ids teach nothing; without toxic labels every text gets the base score; an empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entigraph.llm.common import map_batches, text_chunks
from entigraph.llm.language_id import remainder
from entigraph.llm.pretokenize import LETTER, class_table
from entigraph.plans.workspace import saved

#: Bound of the labelled rows that the lexicon is fitted on.
SAMPLE = 20_000
#: Features, at most, and what each needs: toxic documents, share of toxic ones, different words before it.
FEATURES, LEAST_DOCUMENTS, LEAST_RATE, LEAST_CONTEXTS = 4_000, 3, 0.3, 3
PREFIXES = (4, 5, 6, 7, 8)
BASE_SCORE, THRESHOLD = 0.02, 0.3
#: Strength of the regression's penalty, and its rounds.
PENALTY, ROUNDS = 0.2, 800
#: A feature is sure by itself with this share of toxic documents and so many different words before it.
SURE_RATE, SURE_CONTEXTS = 0.98, 10
#: A feature of this weight, or a sure one, is strong: restoration looks for it.
STRONG = 1.0
#: Copies of a strong feature in the language model, for each document that has it.
LEXICON_WEIGHT = 20.0

_EDGES = "".join(c for c in map(chr, range(33, 0x2100)) if unicodedata.category(c)[0] == "P" and c not in "@$")
#: What a character is commonly written for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
_SEPARATORS = frozenset(" .-_*/,'~:;·")
_COST = {"plain": 0.0, "sign": 1.0, "separator": 0.3, "repeat": 0.3}
_NOISE = re.compile(r"^([$@|+])\1+|([$@|+])\2+$")
_REPEATED = re.compile(r"(\w)\1")
_DISGUISED = re.compile(r"(?=.*[^\W\d_])(?=.*[\W\d_])|.*(\w)\1\1", re.DOTALL)
_SIGNS = re.compile(r"[\W_]*\Z")
#: Words of at most two characters in a row, with signs between them; and signs at the ends that may be letters.
_PIECES = re.compile(r"\+*1(?:[-+]*1)+\+*")
_SYMBOLS = 28  # 0: outside a word; 1 to 26: letters; 27: other letters
#: Restored spans that a worker remembers, and the longest of them; longer ones are decoded anew.
_CACHE, _LONGEST_CACHED = 20_000, 60


@functools.cache
def _folded() -> np.ndarray:
    """Symbol of each code point: its base letter without case and accents."""
    table = np.zeros(0x110000, np.uint8)
    for point in np.flatnonzero(class_table() == LETTER).tolist():
        base = unicodedata.normalize("NFKD", chr(point))[0].lower()
        table[point] = ord(base) - 96 if "a" <= base <= "z" else 27
    return table


def fold(word: str) -> str:
    """Letters a to z of a word; other letters become a question mark, anything else goes."""
    return "".join("?" if s == 27 else chr(96 + s) for s in _folded()[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist() if s)


def words_of(text: str) -> list[str]:
    return [w.strip(_EDGES) for w in text.lower().split()]


def features(words: list[str]) -> set[str]:
    """Words; their beginnings, marked; and, marked twice, beginnings that different words share."""
    own = {w for w in words if w}
    starts = Counter(w[:n] for w in own for n in PREFIXES if len(w) > n)
    return own | {f"{p}*" for p in starts} | {f"{p}**" for p, n in starts.items() if n > 1}


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    out = np.zeros(_SYMBOLS**3, np.int64)
    filled = [t or "" for t in texts]
    for a, b in text_chunks(filled):
        s = _folded()[np.frombuffer(("  " + "  ".join(filled[a:b]) + "  ").encode("utf-32-le"), np.uint32)].astype(np.int64)
        out += np.bincount((s[:-2] * _SYMBOLS + s[1:-1]) * _SYMBOLS + s[2:], minlength=len(out))
    return out


def _squeezed(letters: str) -> str:
    return re.sub(r"(.)\1+", r"\1", letters)


def strong_features(weights: dict[str, float], sure: dict[str, float]) -> list[str]:
    return [f for f, w in weights.items() if (w >= STRONG or f in sure) and not f.endswith("**")]


@dataclass
class Model:
    weights: dict[str, float]
    sure: dict[str, float]  # share of toxic documents
    bias: float
    costs: np.ndarray  # -log P(third symbol | first two), flat

    def __post_init__(self) -> None:
        self.plain = {f for f in self.weights if not f.endswith("*")}
        starts = {f.rstrip("*") for f in self.weights if f.endswith("*")}
        self.starts = {n: {p for p in starts if len(p) == n} for n in PREFIXES}
        strong = strong_features(self.weights, self.sure)
        self.folded = {fold(f): f for f in strong if not f.endswith("*")}
        self.folded_starts = {fold(f[:-1]): f for f in strong if f.endswith("*")}
        self.longest_start = max(map(len, self.folded_starts), default=0)
        self.squeezed = {_squeezed(f) for f in [*self.folded, *self.folded_starts] if f}
        self.beginnings = {f[:n] for f in self.squeezed for n in range(1, len(f) + 1)}
        self.known: dict[str, str] = {}
        self.letters: dict[str, tuple[str, bool]] = {}

    def restore(self, span: str) -> str:
        """The most likely letters behind a span, its words set apart by spaces."""
        if span in self.known:
            return self.known[span]
        symbols = _folded()[np.frombuffer(span.encode("utf-32-le"), np.uint32)].tolist()
        # State: the last two symbols; value: cost and letters, linked backwards.  Every path through the lattice is considered.
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for c, s in zip(span, symbols):
            arcs = [(s, _COST["plain"])] if s else [(ord(x) - 96, _COST["sign"]) for x in LOOKS_LIKE.get(c, "")]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def reach(state: tuple[int, int], cost: float, letters: tuple | None) -> None:
                if state not in after or cost < after[state][0]:
                    after[state] = cost, letters

            for (a, b), (cost, letters) in states.items():
                at = (a * _SYMBOLS + b) * _SYMBOLS
                for x, more in arcs:
                    reach((b, x), cost + more + float(self.costs[at + x]), ("?" if x == 27 else chr(96 + x), letters))
                    if x == b:
                        reach((a, b), cost + _COST["repeat"], letters)
                if not s and (not arcs or not c.isalnum()):
                    usual = c in _SEPARATORS or not arcs
                    reach((a, b), cost + _COST["separator" if usual else "sign"], letters)
                    if b:  # or it does end a word
                        reach((0, 0), cost + _COST["plain" if usual else "sign"] + float(self.costs[at]), (" ", letters))
            states = after
        ends = [(cost + float(self.costs[(a * _SYMBOLS + b) * _SYMBOLS]), letters) for (a, b), (cost, letters) in states.items()]
        node, found = min(ends, key=lambda e: e[0])[1] if ends else None, []
        while node:
            found.append(node[0])
            node = node[1]
        restored = "".join(reversed(found))
        if len(span) <= _LONGEST_CACHED:
            if len(self.known) > _CACHE:
                self.known.clear()
            self.known[span] = restored
        return restored

    def paths(self, span: str) -> Iterator[tuple[int, int]]:
        """Ranges of a span through which its lattice has a path of a strong feature's letters, repeated ones as one."""
        active: dict[str, int] = {}  # letters so far -> where they start
        for k, c in enumerate(span):
            if c not in self.letters:
                s = int(_folded()[ord(c)])
                self.letters[c] = (("?" if s == 27 else chr(96 + s)) if s else LOOKS_LIKE.get(c, "")), not s
            letters, may_go = self.letters[c]
            if not letters:
                continue
            after = dict(active) if may_go else {}
            for x in letters:
                for p, start in (*active.items(), ("", k)):
                    if p and p[-1] == x:
                        after[p] = max(start, after.get(p, 0))
                    if p + x in self.beginnings:
                        after[p + x] = max(start, after.get(p + x, 0))
                        if p + x in self.squeezed:
                            yield start, k + 1
            active = after

    def spans(self, text: str, words: list[str]) -> Iterator[str]:
        """Spans that look disguised: single words, and runs of words of one or two letters."""
        for w in set(words):
            if not w.isalpha():
                w = _NOISE.sub("", w)  # signs in a row at an end disguise nothing
            if len(w) >= 3 and (_REPEATED.search(w) if w.isalpha() else _DISGUISED.match(w)) and any(self.paths(w)):
                yield w
        tokens = text.lower().split()
        for w in {w for w in tokens if w[0] in "!¡(" and len(w) > 2}:  # a sign in place of the first letter
            if w[1].isalnum():
                yield w[0] + w[1:].strip(_EDGES)
        kinds = "".join("1" if 0 < len(w) <= 2 and not _SIGNS.match(w) else "0" if not _SIGNS.match(w) else "+" if any(c in LOOKS_LIKE for c in t) else "-" for w, t in zip(words, tokens))
        for m in _PIECES.finditer(kinds):
            pieces = [w or t for w, t in zip(words[m.start() : m.end()], tokens[m.start() : m.end()])]
            run = " ".join(pieces)
            near = list(self.paths(run))
            if near:
                # The run may begin or end with other short words, which belong to no disguise.
                yield run
                yield " ".join(pieces[1:])
                yield " ".join(pieces[:-1])
                yield from {run[run.rfind(" ", 0, a + 1) + 1 : (run + " ").find(" ", b)] for a, b in near}

    def found(self, own: set[str]) -> set[str]:
        """The model's features among some words."""
        out = self.plain & own
        for n, known in self.starts.items():
            counts = Counter(w[:n] for w in own if w[:n] in known and len(w) > n) if known else {}
            out |= {f for p, k in counts.items() for f in ((f"{p}*", f"{p}**") if k > 1 else (f"{p}*",)) if f in self.weights}
        return out

    def probability(self, found: set[str]) -> float:
        """One minus the chance that neither the regression nor any sure feature speaks for toxicity."""
        clean = 1 / (1 + math.exp(self.bias + math.fsum(self.weights[f] for f in found)))
        return 1 - clean * math.prod(1 - self.sure[f] for f in found if f in self.sure)

    def score(self, text: str | None) -> float:
        words = words_of(text or "")
        found = self.found(set(words))
        if self.folded | self.folded_starts:
            for span in self.spans(text or "", words):
                own = fold(span) if span.isalpha() else ""  # what such a word begins with in plain sight isn't restored
                for letters in self.restore(span).split():
                    if letters in self.folded and letters != own:
                        found.add(self.folded[letters])
                    found |= {self.folded_starts[letters[:n]] for n in range(2, min(len(letters), self.longest_start + 1)) if letters[:n] in self.folded_starts and letters[:n] != own[:n]}
        return self.probability(found)


def language_model(trigrams: np.ndarray, lexicon: dict[str, int]) -> np.ndarray:
    """Costs of trigrams: the corpus and the lexicon in equal parts, each smoothed by shorter contexts."""
    own = np.zeros(_SYMBOLS**3)
    for entry, n in lexicon.items():
        word = fold(entry.rstrip("*"))
        s = [0, 0, *(27 if c == "?" else ord(c) - 96 for c in word), *([] if entry.endswith("*") else [0])]
        for a, b, c in zip(s, s[1:], s[2:]):
            own[(a * _SYMBOLS + b) * _SYMBOLS + c] += LEXICON_WEIGHT * n
    total = sum(_conditional(x) for x in (trigrams.astype(float), own)) / 2
    return -np.log(total).ravel()


def _conditional(trigrams: np.ndarray) -> np.ndarray:
    t = trigrams.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    two, one = t.sum(0), t.sum((0, 1))
    p1 = (one + 1) / (one.sum() + _SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return (t + 5 * p2[None]) / (t.sum(2, keepdims=True) + 5)


def regression(rows: list[list[int]], toxic: np.ndarray, n_features: int) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty over rows of feature numbers, by accelerated gradient steps."""
    which = np.array([f for own in rows for f in own], np.int64)
    of = np.repeat(np.arange(len(rows)), [len(own) for own in rows])
    base = max(1e-4, min(0.5, toxic.mean()))
    w, bias = np.zeros(n_features), math.log(base / (1 - base))
    look, look_bias = w.copy(), bias
    # The curvature is at most a quarter of the largest eigenvalue of the features' products.
    v, largest = np.ones(n_features), 1.0
    for _ in range(30):
        v = np.bincount(which, np.bincount(of, v[which], len(rows))[of], n_features)
        largest = max(1.0, float(np.sqrt((v * v).sum())))
        v = v / largest
    step, step_bias = 1 / (largest / 2 + PENALTY), 2.0 / len(rows)
    for k in range(ROUNDS):
        z = look_bias + np.bincount(of, look[which], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        new = look - step * (np.bincount(which, error[of], n_features) + PENALTY * look)
        new_bias = look_bias - step_bias * error.sum()
        speed = k / (k + 3)
        look, look_bias = new + speed * (new - w), new_bias + speed * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def learned(sample: DataFrame) -> tuple[dict[str, float], dict[str, float], float, dict[str, int]]:
    """Weights, sure features, bias, and toxic documents of each feature; sample: text, toxic (a bounded table)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = list(every)
            columns = [pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([every[f] for f in names], pa.int64())]
            every.clear(), toxic.clear()
            return pa.RecordBatch.from_arrays(columns, ["f", "t", "n"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = features(words_of(text or ""))
                every.update(own)
                if label:
                    toxic.update(own)
                if len(every) > 200_000:
                    yield flush()
        yield flush()

    per = map_batches(sample, count, "f string, t long, n long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    # Twice as many as are used: contexts decide between them.
    good = per.where((F.col("t") >= LEAST_DOCUMENTS) & (F.col("t") >= LEAST_RATE * F.col("n"))).orderBy(F.desc(F.col("t") * F.col("t") / F.col("n")), "f").limit(2 * FEATURES)
    numbers = {r["f"]: (r["t"], r["n"]) for r in good.collect()}  # at most 2 * FEATURES rows
    if not numbers:
        return {}, {}, math.log(BASE_SCORE / (1 - BASE_SCORE)), {}

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, before = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text or "")
                held = features(words) & numbers.keys()
                first = {}
                if label and held:
                    for b, w in zip(["", *words], words):
                        for f in (w, *(f"{w[:n]}*" for n in PREFIXES if len(w) > n)):
                            first.setdefault(f, b)
                own.append(list(held))
                before.append([first.get(f.replace("**", "*"), "") for f in held] if label else [])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.string())), pa.array(before, pa.list_(pa.string()))], ["toxic", "own", "before"])

    rows, toxic, contexts = [], [], {f: set() for f in numbers}
    kind = dict(sample.dtypes)["toxic"]
    for r in map_batches(sample, members, f"toxic {kind}, own array<string>, before array<string>").toLocalIterator():  # at most SAMPLE rows
        rows.append(r["own"])
        toxic.append(bool(r["toxic"]))
        for f, b in zip(r["own"], r["before"]):
            contexts[f].add(b)
    names = [f for f in numbers if len(contexts[f]) >= LEAST_CONTEXTS][:FEATURES]
    place = {f: k for k, f in enumerate(names)}
    w, bias = regression([[place[f] for f in own if f in place] for own in rows], np.array(toxic, float), len(names))
    sure = {f: (numbers[f][0] + 0.3) / (numbers[f][1] + 1) for f in names if len(contexts[f]) >= SURE_CONTEXTS and numbers[f][0] >= SURE_RATE * numbers[f][1]}
    return {f: float(x) for f, x in zip(names, w) if abs(x) > 0.02 or f in sure}, sure, min(bias, math.log(BASE_SCORE / (1 - BASE_SCORE))), {f: numbers[f][0] for f in names}


def fit(docs: DataFrame, labels: DataFrame, trains: Column, key: str = "doc_id", text: str = "text") -> Model:
    """``trains``: a condition on ``key`` of the labels."""
    known = labels.where(trains & F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max("toxic").alias("_toxic"))
    sampled = known.orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(sampled), "_key")  # at most SAMPLE rows
    # Copies of a text teach once.
    rows = rows.groupBy("text").agg(F.max("_toxic").alias("toxic"))
    weights, sure, bias, numbers = learned(saved(rows.select("text", "toxic"), "labelled"))
    strong = {f: numbers[f] for f in strong_features(weights, sure)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            total += trigram_counts(batch.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    trigrams = np.zeros(_SYMBOLS**3, np.int64)
    for r in map_batches(docs.select(text), count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 28 ** 3 rows
        trigrams[r["at"]] = r["n"]
    return Model(weights, sure, bias, language_model(trigrams, strong))


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted: learned from three quarters of the ids, scored for all texts."""
    held_out = remainder(F.col(key), 4) == 2
    model = fit(docs, labels, ~held_out, key, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], [key, "score"])

    done = map_batches(docs.select(key, text), work, f"`{key}` {dict(docs.dtypes)[key]}, score double")
    return done.select(key, held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, that aren't predicted toxic."""
    model = fit(docs, labels, remainder(F.col(key), 4) != 2, key, text)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < THRESHOLD for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(docs, work, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
