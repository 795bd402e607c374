"""BPE, token counts and packing against the public libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from entigraph.llm import bpe, packing, pretokenize, queries, token_counts

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n", "'s's 'll'LL we'll!'s", "a" * 3000, "x<|endoftext|> y<|endoftext|>", "  tail  ", "é中\U0001f600 ٣ \x85 \xa0", "\x1c a\x1fb", "don't\t\tcan't  re'd"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    alphabet = list("  \n\t'''stmdrevl abXY12!?.,é中\U0001f600-")
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 3, 20, 300]))) for _ in range(150)]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pretokens(texts):
    pieces, counts, _ = pretokenize.pretokens(texts)
    want = [regex.findall(public_tokenizers.PATTERN, t) for t in texts]
    assert pieces == [p for own in want for p in own] and counts.tolist() == list(map(len, want))
    assert pretokenize.pretokens([])[0] == []


def test_codes_of_every_class(reference):
    """Code points of all general categories, between letters, as the library splits them."""
    import unicodedata

    chosen, seen = [], set()
    for point in range(0x30000):
        c = chr(point)
        if 0xD800 <= point < 0xE000 or (kind := unicodedata.category(c)) in ("Cn", "Co"):
            continue
        if (kind, point >> 8) not in seen:
            seen.add((kind, point >> 8))
            chosen.append(f"a{c}b {c}{c}")
    assert list(bpe.codec(RANKS).encode(chosen)) == [reference.encode_ordinary(t) for t in chosen]


def test_encode_and_decode(texts, reference):
    codec = bpe.codec(RANKS)
    for text, ids in zip(texts, codec.encode(texts)):
        assert ids == reference.encode_ordinary(text)
        data, offsets = text.encode(), codec.offsets(ids)
        assert codec.decode(ids) == data
        for a, b in ((0, len(data)), (len(data) // 3, len(data) // 2), (1, 2), (0, 0)):
            assert codec.decode_range(ids, offsets, a, b) == data[a:b]


def test_round_trip_query(spark, small, reference):
    rows = {r.doc_id: r for r in queries.op3_bpe_round_trip(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = reference.encode_ordinary(d.text)
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_encode_operators(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, None, "z"), (3, "", None)], "doc_id long, text string, offset string")
    found = bpe.encode(docs, RANKS, ["doc_id", "offset"])
    rows = found.collect()
    assert [len(r.ids) for r in rows] == [2, 2, 0, 0] and rows[0].offsets == [0, 1]
    assert [bytes(r.decoded) for r in bpe.decode(found, RANKS).collect()] == [b"a b", b"a b", b"", b""]
    with pytest.raises(ValueError):
        bpe.encode(docs.withColumnRenamed("offset", "ids"), RANKS, ["ids"])


def test_counts(texts):
    library = Tokenizer.from_file(VOCABULARY)
    assert token_counts.counter(VOCABULARY).counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_query(spark, small):
    library = Tokenizer.from_file(VOCABULARY)
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    rows = {r.doc_id: r for r in queries.op7_token_counts(spark, small).collect()}
    for d in docs:
        n = len(library.encode(d.text, add_special_tokens=False).ids)
        assert (rows[d.doc_id].n_bytes, rows[d.doc_id].n_tokens, rows[d.doc_id].over_limit) == (len(d.text.encode()), n, n > 512)


def check_packing(rows, want, capacity):
    """Every piece of every document once, gapless sequences within capacity; the number of sequences."""
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def expected_pieces(docs, capacity, end_id=0):
    library, out = Tokenizer.from_file(VOCABULARY), []
    for key, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        out += [(key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return out


def test_packing_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = expected_pieces(docs, 2048)
    n = check_packing(queries.op5_best_fit_packing(spark, small).collect(), want, 2048)
    assert n <= -(-sum(w[3] for w in want) // 2048) + 2


def test_packing_edges(spark):
    docs = [(1, "a " * 40), (1, "a " * 40), (2, None), (3, ""), (4, "b c d"), (5, "x<|endoftext|>y"), (6, "word " * 7)]
    table = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, sequence_id int")
    check_packing(packing.pack(table, VOCABULARY, 8).collect(), expected_pieces(docs, 8), 8)
    assert packing.pack(table.limit(0), VOCABULARY, 8).count() == 0


@pytest.mark.parametrize("capacity", [1, 7, 64, 300])
def test_plan(capacity):
    rng = random.Random(capacity)
    lengths = {}
    for _ in range(2000):
        n = min(capacity, max(1, int(rng.lognormvariate(3, 1))))
        lengths[n] = lengths.get(n, 0) + 1
    slots, sequences = packing.plan(lengths, capacity)
    fill, seen = {}, {}
    for s in slots:
        for rank in range(s.first, s.last + 1):
            assert seen.setdefault((s.length, rank), True) is True
            fill.setdefault(s.sequence + rank - s.first, []).append((s.offset, s.length))
    assert len(seen) == 2000 and len(fill) == sequences
    assert all(sum(x[1] for x in own) <= capacity for own in fill.values())
    # No more than plain best fit over the lengths in falling order.
    bins = []
    for n in sorted((n for n, k in lengths.items() for _ in range(k)), reverse=True):
        fits = [k for k, gap in enumerate(bins) if gap >= n]
        if fits:
            bins[min(fits, key=lambda k: bins[k])] -= n
        else:
            bins.append(capacity - n)
    assert sequences <= len(bins)
