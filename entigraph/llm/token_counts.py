"""Token counts of byte-level BPE by rank-synchronous merging of arrays.

Pre-tokens that a worker hasn't counted yet are laid end to end in one array of
symbols.  In each round every pre-token finds its adjacent pair of lowest rank
and merges all occurrences of it at once; a pre-token without a mergeable pair
leaves the arrays, and the symbols that survive in it are its token count.  No
ids are built per text: a text's count is a sum over its pre-tokens.

A special token's string inside a text is one token, as the tokenizer library
has it by default, and parts the text around it.

Defined results: a null text counts like an empty one (0 bytes, 0 tokens);
repeated rows are counted one by one; a pre-token beyond LONG_PIECE characters,
whose rounds would be as many as its length, is merged pair by pair instead.  Memory is bounded by one batch, one text
and CACHE pre-tokens.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from entigraph.llm.common import map_batches, text_chunks
from entigraph.llm.pretokenize import pretokens
from entigraph.llm.vocabulary import json_vocabulary

CACHE = 200_000
#: Characters from which a pre-token's rounds would cost more than a heap of its pairs.
LONG_PIECE = 4096
_NONE = np.iinfo(np.int32).max
_SLOTS_BITS = 20


class PairTable:
    """(left id, right id) -> rank and merged id, by two hashed tables that hold every pair between them."""

    def __init__(self, merges: np.ndarray) -> None:
        self.merged = merges[:, 2].astype(np.int32)
        keys = (merges[:, 0].astype(np.uint64) << np.uint64(32)) | merges[:, 1].astype(np.uint64)
        ranks = np.arange(len(keys), dtype=np.int32)
        self.tables = []
        left = np.arange(len(keys))
        rng = np.random.default_rng(7)
        while len(left):
            factor = np.uint64(int(rng.integers(1, 1 << 62)) * 2 + 1)
            slots = self._slot(keys[left], factor)
            _, first = np.unique(slots, return_index=True)
            own_keys = np.full(1 << _SLOTS_BITS, np.uint64(0xFFFFFFFFFFFFFFFF))
            own_ranks = np.full(1 << _SLOTS_BITS, _NONE, np.int32)
            own_keys[slots[first]], own_ranks[slots[first]] = keys[left[first]], ranks[left[first]]
            self.tables.append((factor, own_keys, own_ranks))
            left = np.delete(left, first)

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((keys * factor) >> np.uint64(64 - _SLOTS_BITS)).astype(np.intp)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        out = np.full(len(keys), _NONE, np.int32)
        for factor, own_keys, own_ranks in self.tables:
            slots = self._slot(keys, factor)
            hit = own_keys[slots] == keys
            out[hit] = own_ranks[slots[hit]]
        return out


def surviving(pieces: list[bytes], byte_ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """How many symbols of each piece survive all merges."""
    out = np.zeros(len(pieces), np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    symbols = byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    who = np.flatnonzero(lengths)  # the pieces that are still in the arrays
    lengths = lengths[who]
    while len(who):
        starts = np.cumsum(lengths) - lengths
        rank = np.full(len(symbols), _NONE, np.int32)
        if len(symbols) > 1:
            rank[:-1] = pairs.ranks(symbols[:-1], symbols[1:])
        rank[starts + lengths - 1] = _NONE  # no pair across pieces
        low = np.minimum.reduceat(rank, starts)
        done = low == _NONE
        out[who[done]] = lengths[done]
        chosen = rank == np.repeat(low, lengths)
        chosen &= np.repeat(~done, lengths)
        places = np.flatnonzero(chosen)
        if len(places) > 1:
            # In a run like aaa the pair occurs at overlapping places: take every other one.
            fresh = np.ones(len(places), bool)
            fresh[1:] = np.diff(places) > 1
            if not fresh.all():
                index = np.arange(len(places))
                run = np.maximum.accumulate(np.where(fresh, index, 0))
                places = places[(index - run) % 2 == 0]
        symbols = symbols.copy()
        symbols[places] = pairs.merged[rank[places]]
        stay = np.repeat(~done, lengths)
        stay[places + 1] = False
        owner = np.repeat(np.arange(len(who)), lengths)
        lengths = lengths - np.bincount(owner[places], minlength=len(who))
        symbols, who, lengths = symbols[stay], who[~done], lengths[~done]
    return out


def surviving_long(piece: bytes, byte_ids: np.ndarray, ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """The same for one very long piece, in n log n steps: pairs in a heap by rank and place."""
    symbols = byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(found[0], k, a, b) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if (found := ranks.get((a, b)))]
    heapq.heapify(heap)
    alive = n
    while heap:
        _, k, a, b = heapq.heappop(heap)
        j = after[k]
        if symbols[k] != a or j >= n or symbols[j] != b:
            continue
        symbols[k], symbols[j], stop = ranks[(a, b)][1], -1, after[j]
        after[k], alive = stop, alive - 1
        if stop < n:
            before[stop] = k
            if found := ranks.get((symbols[k], symbols[stop])):
                heapq.heappush(heap, (found[0], k, symbols[k], symbols[stop]))
        if (p := before[k]) >= 0 and (found := ranks.get((symbols[p], symbols[k]))):
            heapq.heappush(heap, (found[0], p, symbols[p], symbols[k]))
    return alive


class Counter:
    """Counts tokens for one JSON vocabulary, with a bounded memory of pre-tokens."""

    def __init__(self, path: str) -> None:
        vocabulary = json_vocabulary(path)
        self.byte_ids = np.array([vocabulary.tokens[bytes([b])] for b in range(256)], np.int32)
        self.pairs = PairTable(vocabulary.merges)
        self.ranks = {(a, b): (rank, c) for rank, (a, b, c) in enumerate(vocabulary.merges.tolist())}
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.known: dict[str, int] = {}

    def counts(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        parts, owner = list(texts), None
        if self.special and any(map(self.special.search, texts)):
            parts, owner = [], []
            for k, text in enumerate(texts):
                own = self.special.split(text)
                out[k] = len(own) - 1
                parts += own
                owner += [k] * len(own)
        per_part = np.concatenate([np.zeros(0, np.int64), *(self._plain(parts[a:b]) for a, b in text_chunks(parts))])
        if owner is None:
            return out + per_part
        np.add.at(out, np.array(owner, np.intp), per_part)
        return out

    def _plain(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        pieces, counts, _ = pretokens(texts)
        known = self.known
        found = list(map(known.get, pieces))
        new = list({pieces[k]: None for k, n in enumerate(found) if n is None})
        if new:
            short = [p for p in new if len(p) <= LONG_PIECE]
            known.update(zip(short, surviving([p.encode() for p in short], self.byte_ids, self.pairs).tolist()))
            known.update((p, surviving_long(p.encode(), self.byte_ids, self.ranks)) for p in new if len(p) > LONG_PIECE)
            found = [known[p] if n is None else n for p, n in zip(pieces, found)]
        sums = np.concatenate([[0], np.cumsum(np.array(found, np.int64))])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns: key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
            n = own.counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[key]
    return map_batches(docs.select(key, text), work, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
