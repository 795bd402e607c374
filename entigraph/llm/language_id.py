"""Language identification by nearest centroids.

A text becomes the counts of its letter bigrams and trigrams (other characters
are word ends), hashed into a fixed number of features, damped, weighted by
inverse document frequency and normalised.  Each language has several
centroids, found by spherical k-means on its own texts; a text gets the language
of the centroid with the largest cosine.  Distance-based rejection: a text whose
cosine is below what its language's own texts reach is marked as rejected.  The
cosine of a short text grows with the root of its number of different features,
so cosines are compared for a text of ``WHOLE`` of them.

The classifier (document frequencies, centroids, rejection limits) is fitted on
at most ``sample`` labelled rows in all, the same number per language, those
with the smallest hash of their id; every text is predicted whole.

Defined results: a null text, one without letters, and any text where nothing
could be learned is ``und`` with score 0 and rejected; an id that is repeated
with one label teaches the smallest of its texts; of more than ``SAMPLE``
languages those with most documents are learned; of centroids with equal
cosines the first counts, in the order of the languages' names; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entigraph.llm.common import map_batches
from entigraph.llm.pretokenize import LETTER, class_table

UNKNOWN = "und"
FEATURES = 4096
#: Bound of the fitted sample: rows in all, and rows of one language.
SAMPLE, PER_LANGUAGE = 3000, 300
CENTROIDS = 4
#: A text is rejected below this share of the cosine that all but a few of its language's texts reach: between the
#: least share of clean texts (0.42, sf0.1) and those of foreign sentences and letter junk (0.12 to 0.4).
REJECT_SHARE, REJECT_QUANTILE = 0.41, 0.01
#: Different features from which on a text's cosine no longer grows with its length.
WHOLE = 300
#: Ids that are looked at for each one of the sample.
_SPARE = 4
_GROUP = 64
_LONGEST = 1 << 20


def counts(texts: list[str | None]) -> np.ndarray:
    """Hashed counts of bigrams and trigrams, a row per text."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    lowered = [(t or "").lower() for t in texts]
    start = 0
    while start < len(lowered):
        stop, size = start, 0
        while stop < len(lowered) and stop - start < _GROUP and (not size or size + len(lowered[stop]) <= _LONGEST):
            size += len(lowered[stop])
            stop += 1
        own = lowered[start:stop]
        points = np.frombuffer((" " + "  ".join(own) + " ").encode("utf-32-le"), np.uint32)
        lengths = np.fromiter((len(t) + 2 for t in own), np.int64, len(own))
        row = np.repeat(np.arange(len(own)), lengths)
        letter = class_table()[points] == LETTER
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one word end after each word
        keep[np.cumsum(lengths) - lengths] = True  # and one before the first
        code, row = np.where(letter, points, 32)[keep].astype(np.uint32), row[keep]
        for n in (2, 3):
            if len(code) < n:
                continue
            same = row[: len(row) - n + 1] == row[n - 1 :]
            h = np.full(len(same), 2166136261 + n, np.uint32)
            for k in range(n):
                h = (h ^ code[k : len(code) - n + 1 + k]) * np.uint32(16777619)
                h ^= h >> np.uint32(15)
            slot = row[: len(same)][same] * FEATURES + (h[same] & np.uint32(FEATURES - 1)).astype(np.int64)
            out[start:stop] += np.bincount(slot, minlength=len(own) * FEATURES).reshape(-1, FEATURES)
        start = stop
    return out


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return bool((class_table()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] == LETTER).any())


def vectors(raw: np.ndarray, weights: np.ndarray) -> np.ndarray:
    v = np.log1p(raw) * weights
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def clustered(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart seeds; deterministic."""
    centre = v.mean(0)
    chosen = [int(np.argmax(v @ centre))]
    near = v @ v[chosen[0]]
    while len(chosen) < min(k, len(v)):
        chosen.append(int(np.argmin(near)))
        near = np.maximum(near, v @ v[chosen[-1]])
    centroids = v[chosen]
    for _ in range(rounds):
        own = (v @ centroids.T).argmax(1)
        sums = np.stack([v[own == c].sum(0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-12)
    return centroids


def length_share(raw: np.ndarray) -> np.ndarray:
    """The share of the cosine of a long text that a text of so many different features may reach."""
    return np.sqrt(np.clip((raw > 0).sum(1), 1, WHOLE) / WHOLE)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # of features
    centroids: np.ndarray
    owner: np.ndarray  # language of each centroid
    least: np.ndarray  # rejection limit of each language, for texts of WHOLE features

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        if not len(self.centroids):
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        cosine, share = np.zeros((len(texts), len(self.owner)), np.float32), np.zeros(len(texts))
        for a in range(0, len(texts), _GROUP):
            raw = counts(texts[a : a + _GROUP])
            cosine[a : a + _GROUP], share[a : a + _GROUP] = vectors(raw, self.weights) @ self.centroids.T, length_share(raw)
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        languages, rejected = [], []
        for k, text in enumerate(texts):
            known = has_letter(text)
            own = self.owner[best[k]]
            languages.append(self.languages[own] if known else UNKNOWN)
            rejected.append(not known or score[k] < self.least[own] * share[k])
            score[k] *= known
        return languages, score, rejected


def fit(docs: DataFrame, trains: Column, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """Fit on labelled rows where ``trains`` holds."""
    labelled = docs.where(trains & F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(label).alias("lang"))
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()
    if not sizes:
        return Model([], np.ones(FEATURES, np.float32), np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0))
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(sizes)))
    # Ids below a limit of the hash, some more than are needed: so many that each language has enough, and no language is gathered.
    chance = {r["lang"]: min(1.0, (_SPARE * each + 50) / r["count"]) for r in sizes}
    limits = docs.sparkSession.createDataFrame([(lang, int(c * (1 << 62)) * 4 - (1 << 63) if c < 1 else (1 << 63) - 1) for lang, c in chance.items()], "lang string, most long")
    hashed = labelled.select("id", "lang", F.xxhash64("id").alias("h")).join(F.broadcast(limits), "lang").where("h <= most")  # SAMPLE rows at most
    few: dict[str, list] = {r["lang"]: [] for r in sizes}
    for r in hashed.select("lang", "h", "id").distinct().collect():  # some 4 * SAMPLE ids
        few[r["lang"]].append(r)
    chosen = [(r["id"], lang) for lang, own in few.items() for r in sorted(own, key=lambda r: (r["h"], str(r["id"])))[:each]]
    ids = docs.sparkSession.createDataFrame(chosen, f"sampled {dict(docs.dtypes)[key]}, lang string")
    # At most SAMPLE ids: a bounded broadcast, so that only sampled texts are moved; a repeated id teaches once.
    rows = labelled.join(F.broadcast(ids), labelled["id"].eqNullSafe(ids["sampled"]) & (labelled["lang"] == ids["lang"])).groupBy("id", labelled["lang"]).agg(F.min("text").alias("text")).select("text", "lang")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = counts(batch.column(0).to_pylist()).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in raw], pa.binary())], ["lang", "raw"])

    found = map_batches(rows, work, "lang string, raw binary").collect()  # at most SAMPLE rows
    languages = sorted(few)
    found.sort(key=lambda r: (r["lang"], r["raw"]))
    raw = np.stack([np.frombuffer(r["raw"], np.float32) for r in found])
    own = np.array([languages.index(r["lang"]) for r in found])
    weights = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1).astype(np.float32)
    v = vectors(raw, weights)
    useful = raw.any(1)
    centroids, owner, least = [], [], np.zeros(len(languages))
    for k in range(len(languages)):
        mine = v[(own == k) & useful]
        if len(mine):
            c = clustered(mine, CENTROIDS)
            centroids.append(c)
            owner += [k] * len(c)
            least[k] = REJECT_SHARE * np.quantile((mine @ c.T).max(1) / length_share(raw[(own == k) & useful]), REJECT_QUANTILE)
    stacked = np.concatenate(centroids) if centroids else np.zeros((0, FEATURES))
    return Model(languages, weights, stacked.astype(np.float32), np.array(owner, np.int64), least)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % divisor


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score, rejected."""
    if clash := {"lang_pred", "score", "rejected"} & set(keep):
        raise ValueError(f"columns {sorted(clash)} are results of this operator: rename them first")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, score, rejected = model.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(languages, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*keep, "lang_pred", "score", "rejected"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double, rejected boolean"])
    return map_batches(docs.select(*keep, F.col(text)), work, schema)


def identified(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """key, held_out, lang_pred, score, rejected: learned from two thirds of the ids, predicted for all texts."""
    held_out = remainder(F.col(key), 3) == 1
    model = fit(docs, ~held_out, key, text, label)
    done = predict(docs, model, [key], text)
    return done.select(key, held_out.alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """The documents, with all their columns, whose language is identified and not rejected."""
    model = fit(docs, remainder(F.col(key), 3) != 1, key, text, label)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, rejected = model.predict(batch.column(at).to_pylist())
            yield batch.filter(pa.array(np.logical_not(rejected)))

    return map_batches(docs, work, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes))
