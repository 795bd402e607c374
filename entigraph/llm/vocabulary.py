"""Vocabulary files of public byte-level BPE tokenizers; their paths are parameters."""

from __future__ import annotations

import base64
import functools
import json
from dataclasses import dataclass

import numpy as np


@functools.cache
def ranks_of(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    """Rank of each token, and the tokens by rank, of a rank file (one base64 token and its rank a line)."""
    ranks: dict[bytes, int] = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in JSON vocabularies: the byte itself where printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    return letters


@dataclass(frozen=True)
class JsonVocabulary:
    tokens: dict[bytes, int]  # without added tokens
    merges: np.ndarray  # rows: left id, right id, merged id, in order of rank
    special: dict[str, int]


@functools.cache
def json_vocabulary(path: str) -> JsonVocabulary:
    with open(path, encoding="utf-8") as file:
        data = json.load(file)
    letters, vocabulary = byte_alphabet(), data["model"]["vocab"]
    special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
    plain = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    pairs = [x if isinstance(x, list) else x.split(" ") for x in data["model"]["merges"]]
    merges = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
    return JsonVocabulary(plain, merges, special)
