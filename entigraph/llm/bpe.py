"""Byte-level BPE encoding and decoding with a public rank file.

Pre-token boundaries come from the codepoint-class scan of ``pretokenize``; each
distinct pre-token is merged once per worker and cached.  Encoding keeps, next
to the ids, the byte offset at which every token starts, so that any byte range
of a text can be decoded from its tokens alone.

Defined results: a null text is encoded like an empty one (no ids, no offsets);
repeated rows are encoded one by one; strings of special tokens are ordinary
text; a pre-token of any length is merged whole, in n log n steps.  Memory is bounded by one batch, one text and CACHE pre-tokens.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from entigraph.llm.common import map_batches, text_chunks
from entigraph.llm.pretokenize import pretokens
from entigraph.llm.vocabulary import ranks_of

#: Pre-tokens that a worker remembers of late; beyond that these become the older ones, and what was older is forgotten.
CACHE = 150_000
#: Bytes that a round trip decodes at once.
DECODED = 1 << 16
#: Longer pre-tokens are merged with a heap (n log n) instead of repeated minima.
_LONG = 128
_NONE = 1 << 60


def merged(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: the adjacent pair of lowest rank is merged, again and again."""
    if piece in ranks:
        return (ranks[piece],)
    if len(piece) > _LONG:
        return _merged_long(piece, ranks)
    get = ranks.get
    cuts = list(range(len(piece) + 1))  # part k is between cuts k and k + 1
    rank = [get(piece[k : k + 2], _NONE) for k in range(len(piece) - 1)]
    while rank:
        low = min(rank)
        if low == _NONE:
            break
        k = rank.index(low)
        del cuts[k + 1], rank[k]
        if k:
            rank[k - 1] = get(piece[cuts[k - 1] : cuts[k + 1]], _NONE)
        if k < len(rank):
            rank[k] = get(piece[cuts[k] : cuts[k + 2]], _NONE)
    return tuple([ranks[piece[a:b]] for a, b in pairwise(cuts)])


def _merged_long(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    get, n = ranks.get, len(piece)
    end = list(range(1, n + 1))  # of the part that starts at k; 0: swallowed
    before = list(range(-1, n - 1))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, stop = heapq.heappop(heap)
        middle = end[k]
        if not middle or middle >= n or end[middle] != stop:
            continue
        end[k], end[middle] = stop, 0
        if stop < n:
            before[stop] = k
            if (r := get(piece[k : end[stop]])) is not None:
                heapq.heappush(heap, (r, k, end[stop]))
        if (p := before[k]) >= 0 and (r := get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : end[k]]])
        k = end[k]
    return tuple(out)


class Codec:
    """Encoder and decoder over one rank file, with a bounded memory of pre-tokens."""

    def __init__(self, path: str) -> None:
        self.ranks, self.tokens = ranks_of(path)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        #: Pre-tokens met lately, and those met before; one used again moves up, so common ones outlive a full memory.
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: Sequence[str]) -> Iterator[list[int]]:
        """Ids of each text, in order."""
        for a, b in text_chunks(texts):
            pieces, counts, _ = pretokens(list(texts[a:b]))
            if len(self.known) > CACHE:
                self.known, self.older = {}, self.known
            known, older, ranks = self.known, self.older, self.ranks
            found = list(map(known.get, pieces))
            for k, ids in enumerate(found):
                if ids is None:
                    piece = pieces[k]
                    ids = known.get(piece)  # the piece may have stood earlier in this chunk
                    if ids is None:
                        ids = known[piece] = older.get(piece) or merged(piece.encode(), ranks)
                    found[k] = ids
            at = 0
            for n in counts.tolist():
                yield list(chain.from_iterable(found[at : at + n]))
                at += n

    def offsets(self, ids: Sequence[int]) -> np.ndarray:
        """Byte offset of each token in its text."""
        sizes = self.lengths[np.asarray(ids, np.int64)] if len(ids) else np.zeros(0, np.int64)
        return np.cumsum(sizes) - sizes

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode_range(self, ids: Sequence[int], offsets: Sequence[int], start: int, stop: int) -> bytes:
        """Bytes [start, stop) of the text, from the tokens that cover them."""
        if stop <= start or not len(ids):
            return b""
        a = int(np.searchsorted(offsets, start, "right")) - 1
        b = int(np.searchsorted(offsets, stop, "left"))
        return self.decode(ids[a:b])[start - offsets[a] : stop - offsets[a]]


@functools.cache
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def _refuse(columns: Sequence[str], own: Sequence[str]) -> None:
    if clash := set(columns) & set(own):
        raise ValueError(f"columns {sorted(clash)} are results of this operator: rename them first")


def encode(docs: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, ``ids`` (array of int) and ``offsets`` (array of long: byte offset of each token)."""
    _refuse(keep, ["ids", "offsets"])
    keep = list(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(keep)).to_pylist()]
            ids = list(own.encode(texts))
            offsets = [own.offsets(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(ids, pa.list_(pa.int32())), pa.array(offsets, pa.list_(pa.int64()))], [*keep, "ids", "offsets"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>", "offsets array<bigint>"])
    return map_batches(docs.select(*keep, text), work, schema)


def decode(encoded: DataFrame, path: str, keep: Sequence[str] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and ``decoded`` (binary); null ids decode to nothing, an id outside the file is an error."""
    _refuse(keep, ["decoded"])
    keep = list(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            out = [own.decode(x or ()) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], [*keep, "decoded"])

    kinds = dict(encoded.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "decoded binary"])
    return map_batches(encoded.select(*keep, ids), work, schema)


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text in one pass and return digests of both results.

    Columns: key, n_tokens, ids_sha256 (decimal ids joined by one space),
    decoded_sha256 (decoded bytes), n_bytes (where the last token ends).
    Texts are decoded range by range of ``DECODED`` bytes, each from the tokens
    that the offsets name.  The ids never leave the worker, so no shuffle and no
    copy of them is made.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        decimal = [b"%d" % k for k in range(len(own.tokens))]
        sha = hashlib.sha256
        for batch in batches:
            n, of_ids, of_bytes, ends = [], [], [], []
            for ids in own.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids))
                of_ids.append(sha(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                offsets, digest = own.offsets(ids), sha()
                end = int(offsets[-1] + own.lengths[ids[-1]]) if ids else 0
                for a in range(0, end, DECODED):
                    digest.update(own.decode_range(ids, offsets, a, min(a + DECODED, end)))
                of_bytes.append(digest.hexdigest())
                ends.append(end)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string()), pa.array(ends, pa.int64())], [key, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    kind = dict(docs.dtypes)[key]
    return map_batches(docs.select(key, text), work, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint")
