"""Text analysis: tokens, stop words, stems."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entigraph.functions.stemmer import stem

#: The words that the default analysis leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it",
    "its", "of", "on", "or", "that", "the", "to", "was", "were", "will", "with",
)


@dataclass(frozen=True)
class Analysis:
    """Scoring parameters and steps of an analysis."""

    k1: float
    b: float
    stems: bool
    stops: bool
    least: int = 2


#: Fixed values of the named configurations.
CONFIGS = {
    "default": Analysis(1.2, 0.75, True, True, 2),
    "precise": Analysis(1.5, 0.5, False, False, 1),
    "recall": Analysis(1.0, 0.75, True, True, 2),
}


#: Letters that lower-casing would turn into two characters, or into one that depends on its place: here each has one small letter.
_SMALL = {"İ": "i", "Σ": "σ"}


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of at least two bytes."""
    own = F.coalesce(text, F.lit(""))
    for large, one in _SMALL.items():
        own = F.replace(own, F.lit(large), F.lit(one))
    parts = F.split(F.lower(own), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: F.octet_length(t) >= 2)


def token_list(text: str) -> list[str]:
    """The same for a query on the driver, by the same classes of characters."""
    for large, one in _SMALL.items():
        text = text.replace(large, one)
    return [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if len(t.encode()) >= 2]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(words: pd.Series) -> pd.Series:
    known = functools.cache(stem)
    return words.map(lambda own: None if own is None else [known(w) for w in own])


def analyzed(text: Column, config: Analysis) -> Column:
    """Terms of a text in order: positions count after stop words are gone."""
    own = tokens(text)
    if config.stops:
        own = F.filter(own, lambda t: ~t.isin(*STOP_WORDS))
    if config.stems:
        own = _stemmed(own)  # the one step that built-in functions can't say
    return F.filter(own, lambda t: F.octet_length(t) >= config.least)


def analyzed_list(text: str, config: Analysis) -> list[str]:
    own = [t for t in token_list(text) if not (config.stops and t in STOP_WORDS)]
    own = [stem(t) for t in own] if config.stems else own
    return [t for t in own if len(t.encode()) >= config.least]
