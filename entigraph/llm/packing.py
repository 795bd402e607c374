"""Best-two-fit packing of token sequences.

Bins are filled greedily with the longest piece that still fits; then the
smallest piece of the bin is taken out again and replaced by two unpacked
pieces whose lengths together fill the widened gap more tightly.

Only lengths matter for that choice, and there are at most ``capacity`` of
them: the corpus is reduced to a histogram of lengths, the driver packs the
histogram (a step repeats unchanged until some length runs out, so it is taken
with its multiplicity), and the resulting plan deals the pieces of each length,
in the order of their rank, to places in sequences.  The plan has the same
bounded size for any number of documents, every piece is packed globally, and
only rows of a few numbers are shuffled.

Defined results: a null text is an empty one, which is the end token alone;
texts of any length are encoded whole, runs of blanks or letters of any length
among them; documents longer than the capacity are cut into full pieces, the first piece
takes the remainder; repeated rows are packed each on their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entigraph.llm.common import map_batches, text_chunks
from entigraph.llm.pretokenize import pretokens
from entigraph.llm.vocabulary import json_vocabulary
from entigraph.plans.workspace import saved

#: Rows of one length are ranked in parts of about this many.
_RANKED_ROWS = 1_000_000


class Slots(NamedTuple):
    """Ranks [first, last] of a length go to ``offset`` in the sequences from ``sequence`` on."""

    length: int
    first: int
    last: int
    sequence: int
    offset: int


def _largest_up_to(present: np.ndarray) -> np.ndarray:
    """For each x the largest length that is present and at most x, else 0."""
    return np.maximum.accumulate(np.where(present, np.arange(len(present)), 0))


def _fill(left: np.ndarray, capacity: int) -> list[int]:
    """One bin's lengths by best-two-fit; ``left`` counts the unpacked pieces of each length."""
    left = left.copy()
    gap, held = capacity, []
    while True:
        best = int(_largest_up_to(left > 0)[gap])
        if not best:
            break
        held.append(best)
        left[best] -= 1
        gap -= best
    if gap and held:
        smallest = held[-1]
        room = gap + smallest
        fits = _largest_up_to(left > 0)
        one = np.flatnonzero(left[: room + 1] > 0)
        if len(one):
            partner = fits[room - one]
            same = partner == one  # needs two of them, else the next shorter one
            short = same & (left[one] < 2)
            partner[short] = [fits[x - 1] if x else 0 for x in one[short]]
            both = np.where(partner > 0, one + partner, 0)
            k = int(np.argmax(both))
            if both[k] > smallest:
                held[-1:] = sorted((int(one[k]), int(partner[k])), reverse=True)
    return held


def plan(lengths: dict[int, int], capacity: int) -> tuple[list[Slots], int]:
    """Where the pieces of each length go, and the number of sequences."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left[length] += n
    used, slots, sequences = Counter(), [], 0
    while left.any():
        held = _fill(left, capacity)
        per_bin = Counter(held)
        times = min(int(left[x]) // n for x, n in per_bin.items())
        offset = 0
        for x in held:
            slots.append(Slots(x, used[x], used[x] + times - 1, sequences, offset))
            used[x] += times
            offset += x
        for x, n in per_bin.items():
            left[x] -= n * times
        sequences += times
    return slots, sequences


def packed(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    ``pieces`` is read several times: pass a written table.  ``order`` makes
    the ranks within a length deterministic; rows that agree in it must be
    interchangeable.  A length that holds most rows is ranked in many parts.
    """
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    slots, _ = plan(histogram, capacity)
    parts = min(4096, max(8, -(-sum(histogram.values()) // _RANKED_ROWS)))
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order))
    ranked = dealt.withColumn("_within", within).join(bases, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_base") + F.col("_within") - 1)
    schema = "_length int, _first bigint, _last bigint, _sequence bigint, _offset bigint"
    # The plan has a few lengths per step and about as many steps as lengths: bounded by the capacity.
    places = F.broadcast(pieces.sparkSession.createDataFrame([tuple(s) for s in slots], schema))
    here = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_first"), F.col("_last"))
    sequence = F.col("_sequence") + F.col("_rank") - F.col("_first")
    return ranked.join(places, here).select(*pieces.columns, sequence.alias("sequence_id"), F.col("_offset").alias("offset"))


@functools.cache
def _tokenizer(path: str):
    """The vocabulary of a JSON file behind the faster of the two public libraries; ids are the same."""
    import tiktoken

    vocabulary = json_vocabulary(path)
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ranks = {token: k for k, token in enumerate([bytes([b]) for b in sorted(range(256), key=lambda b: vocabulary.tokens[bytes([b])])])}
    by_id = {i: t for t, i in vocabulary.tokens.items()}
    for merged in vocabulary.merges[:, 2].tolist():
        ranks.setdefault(by_id[merged], len(ranks))
    if any(vocabulary.tokens[t] != r for t, r in ranks.items()):
        raise ValueError("this vocabulary's ids don't follow its merges")
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens=vocabulary.special)


#: Longer texts are split by the class scan of ``pretokenize``: a regular expression's stack is bounded.
LONG_TEXT = 1 << 16


def token_ids(path: str, text: str) -> list[int]:
    """Ids of a text of any length, special strings as one token each."""
    encoding = _tokenizer(path)
    if len(text) <= LONG_TEXT:
        return encoding.encode(text, allowed_special="all")
    special, known, out = json_vocabulary(path).special, {}, []
    parts = re.split("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")", text) if special else [text]
    for part in parts:
        if part in special:
            out.append(special[part])
            continue
        for piece in pretokens([part])[0]:
            if piece not in known:
                known[piece] = encoding._encode_single_piece(piece.encode())
            out += known[piece]
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: all full but the first, which takes the remainder."""
    first = (n - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, append ``end_id`` and cut: key, piece, start, length, ids_crc32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            rows, out = [], [[], [], [], []]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_chunks(texts):
                for k in range(a, b):
                    ids = np.concatenate([np.array(token_ids(path, texts[k]), np.uint32), tail]).astype("<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        rows.append(k)
                        for column, value in zip(out, (piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))):
                            column.append(value)
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(out, kinds))], [key, "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[key]
    return map_batches(docs.select(key, text), work, f"`{key}` {kind}, piece int, start bigint, length int, ids_crc32 bigint")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Offsets within a sequence are gapless from 0; sequences are numbered from 0.
    """
    pieces = saved(token_pieces(docs, path, capacity, end_id, key, text), "pieces")
    done = packed(pieces, capacity, [key, "start", "ids_crc32"])
    return done.select(key, "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("long").alias("offset"))
