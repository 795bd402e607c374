"""Texts that break regular expressions, against the public libraries."""

import base64
import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import harness
from entigraph.llm import bpe, packing, queries, token_counts, warc

RANKS, VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
LONG = {"blanks": " " * 2_000_000 + "x", "letters": "ab" * 500_000, "line ends": "\n" * 1_000_000 + "tail", "mixed": "it's <|endoftext|> né 12\n" * 6_000}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.mark.parametrize("name", LONG)
def test_one_very_long_text(name, library):
    text = LONG[name]
    want = library.encode(text, add_special_tokens=False).ids
    assert packing.token_ids(VOCABULARY, text) == want
    began = time.perf_counter()
    assert token_counts.counter(VOCABULARY).counts([text]).tolist() == [len(want)]
    assert time.perf_counter() - began < 60
    plain = text.replace("<|endoftext|>", "")
    codec = bpe.codec(RANKS)
    ids = next(codec.encode([plain]))
    assert ids == library.encode(plain, add_special_tokens=False).ids and codec.decode(ids) == plain.encode()


def test_long_pieces_count_as_short_ones(library, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_PIECE", 3)
    texts = ["aaaaaaaaab", "banana bandana", "xyzzy" * 30, "strengthlessness", "ééééé", "  \n\n\n   x"]
    assert token_counts.Counter(VOCABULARY).counts(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


EDGES = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (4, " " * 70_000 + "x"), (5, "z" * 70_000)]


def test_round_trip_edges(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    slow = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    table = spark.createDataFrame([(*e, "x", 1) for e in EDGES], "doc_id long, text string, ids_sha256 string, n_tokens int")
    sha = lambda data: hashlib.sha256(data).hexdigest()
    want = []
    for k, t in EDGES:
        ids = slow.encode_ordinary(t or "")
        want.append((k, len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()), len(t or "")))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.n_bytes) for r in bpe.round_trip(table, RANKS).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert bpe.round_trip(table.limit(0), RANKS).count() == 0


def test_count_edges(spark, library):
    table = spark.createDataFrame([(*e, "x") for e in EDGES], "doc_id long, text string, n_tokens string")
    want = [(k, len(t or ""), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for k, t in EDGES]
    assert sorted(map(tuple, token_counts.token_counts(table, VOCABULARY).collect()), key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(table.limit(0), VOCABULARY).count() == 0


def test_packing_edges_of_long_texts(spark):
    from test_tokens import check_packing, expected_pieces

    table = spark.createDataFrame([(*e, 1) for e in EDGES if e[0]], "doc_id long, text string, piece int")
    check_packing(packing.pack(table, VOCABULARY, 64).collect(), expected_pieces([e for e in EDGES if e[0]], 64), 64)


def test_decoding_range_by_range(monkeypatch):
    monkeypatch.setattr(bpe, "DECODED", 3)
    codec, text = bpe.codec(RANKS), "née 中文 tokens and so on"
    ids = next(codec.encode([text]))
    offsets, data = codec.offsets(ids), text.encode()
    assert b"".join(codec.decode_range(ids, offsets, a, min(a + 3, len(data))) for a in range(0, len(data), 3)) == data


def test_full_shards_are_rolled(spark, tmp_path):
    """With the default share a full shard has several files."""
    rng = np.random.default_rng(0)
    rows = [(k, "u", " ".join(map(str, rng.integers(0, 10**6, 400)))) for k in range(300)]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"), shard_bytes=200_000)
    files = [r.file for r in spark.read.parquet(str(tmp_path / "w" / "manifest")).collect()]
    assert len(files) > 2 * len({f.rsplit("-", 1)[0] for f in files})
    assert warc.read(spark, str(tmp_path / "w")).count() == 300


def test_names_of_object_stores():
    assert warc.file_system("/tmp")[1] == "/tmp"
    assert warc.file_system("file:///tmp")[1] == "/tmp"


@pytest.mark.parametrize("name", ["quality_of_failing_hosts", "quality_host_rates"])
def test_hosts_that_fail(spark, small, name):
    sf = small.replace("0.001", "0.01")
    assert harness.difference(queries.queries()[name](spark, sf), sf, queries.oracle_sql()[name]) == ""
    if name == "quality_of_failing_hosts":
        assert queries.queries()[name](spark, sf).where("not base_failed and not kept").count() > 0
