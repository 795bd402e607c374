"""Near-duplicates of texts and vectors against brute force."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import harness
from entigraph.llm import common, components, embedding_dedup, queries, simhash_dedup


def labels(n, pairs, names):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    low = {}
    for k in range(n):
        if names[k] is not None:
            low[find(k)] = min(low.get(find(k), names[k]), names[k])
    return [low.get(find(k)) for k in range(n)]


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return [b" ".join(w)] if 0 < len(w) < k else [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)]


def slow_fingerprint(text, k=3):
    own = [xxhash.xxh64_intdigest(s, 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own))


def expected(docs, radius=2):
    fp = np.array([slow_fingerprint(t) for _, t in docs], np.uint64)
    pairs = [(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= radius) if j > i]
    return fp, labels(len(docs), pairs, [k for k, _ in docs])


EDGES = [(5, "one two three four"), (5, "one two three four"), (6, "ONE two three FOUR"), (7, None), (8, ""), (9, "\t\n"), (None, "one two three four"), (10, "one"), (11, "one two"), (12, "É one"), (13, "é one"), (14, "w " * 50_000)]


def test_fingerprints_query(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    fp, component = expected(docs)
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash_dedup(spark, small).collect()}
    assert rows == {k: (f"{f:016x}", c) for (k, _), f, c in zip(docs, fp.tolist(), component)}


@pytest.mark.parametrize("max_run", [simhash_dedup.MAX_RUN, 1])
def test_fingerprint_edges(spark, max_run):
    table = spark.createDataFrame([(*d, "x", 1) for d in EDGES], "doc_id long, text string, component_id string, fp int")
    fp, component = expected(EDGES)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash_dedup.fingerprint_groups(table, max_run=max_run).collect()), key=repr)
    assert got == sorted(((k, f, c) for (k, _), f, c in zip(EDGES, fp.view(np.int64).tolist(), component)), key=repr)
    assert simhash_dedup.fingerprint_groups(table.limit(0)).count() == 0


def test_dense_family_is_linked_whole(spark):
    """Thousands of fingerprints around one: a long run of one probe, and few links leave it."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(1, 1 << 62))
    members = {base ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c)) for a, b, c in rng.integers(0, 63, (3000, 3))} | {base}
    nodes = spark.createDataFrame([(m, [m]) for m in members], "id long, sig array<long>")
    probes = simhash_dedup.radius_plan(simhash_dedup.joint_bits(nodes, 1)[0], len(members), 2)
    links = simhash_dedup.probed_links(nodes, probes, 1, 2)
    assert links.count() <= len(probes) * len(members)
    found = components.connected_components(links)
    keys = np.array(sorted(members), np.uint64)
    pairs = [(i, int(j)) for i in range(len(keys)) for j in np.flatnonzero(np.bitwise_count(keys[i] ^ keys) <= 2) if j > i]
    want = labels(len(keys), pairs, keys.tolist())
    got = {r.node: r.component for r in found.collect()}
    assert all(got.get(int(k), int(k)) == w for k, w in zip(keys, want))


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_every_pair_within_the_radius_meets(radius):
    rng = np.random.default_rng(radius)
    bits = rng.random((400, 64)) < rng.uniform(0.2, 0.8, 64)
    joint = bits.T.astype(float) @ bits
    probes = simhash_dedup.radius_plan(joint, 400, radius)
    for _ in range(2000):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, radius, replace=False):
            b ^= 1 << int(bit)
        assert any(all((a ^ b) & m.bits == 0 for m in p) for p in probes)


def test_similar_groups(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    base = " ".join(f"w{k}" for k in range(300))
    docs += [(10_001, base), (10_002, base.replace("w150 ", "zz ")), (10_003, base.replace("w10 ", "").replace("w200 ", "y ")), (10_004, " ".join(f"v{k}" for k in range(300))), (10_005, base.upper().replace(" ", "\n"))]
    sets = [set(shingles(t, 5)) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = labels(len(docs), pairs, [k for k, _ in docs])
    table = spark.createDataFrame([(*d, "kept") for d in docs], "doc_id long, text string, node string")
    decided = {r.doc_id: (r.component_id, r.kept) for r in simhash_dedup.similar_groups(table).collect()}
    assert decided == {k: (c, k == c) for (k, _), c in zip(docs, want)}
    left = simhash_dedup.deduplicated(table)
    assert left.columns == table.columns and sorted(r.doc_id for r in left.collect()) == sorted(set(want))


@pytest.mark.parametrize("block", [simhash_dedup.BLOCK_ROWS, 40, 3])
def test_links_that_a_forest_leaves_out(spark, block):
    """Variants of one text around the limit: forests by fingerprints hold few of their links."""
    rng = np.random.default_rng(3)
    docs = []
    for k in range(200):
        words = [f"w{i}" for i in range(250)]
        for i in rng.choice(250, 4, replace=False):
            words[i] = f"x{k}"
        docs.append((k, " ".join(words)))
    sets = [set(shingles(t, 5)) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = labels(len(docs), pairs, [k for k, _ in docs])
    assert 20 < len(set(want)) < 180
    decided = simhash_dedup.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), block=block)
    assert {r.doc_id: r.component_id for r in decided.collect()} == dict(zip((k for k, _ in docs), want))


def test_a_long_family_of_one_group_and_stragglers(spark):
    """Most of a family is one group, whose blocks needn't meet; the rest is compared with each of them."""
    rng = np.random.default_rng(5)
    docs = [(k, " ".join(f"w{i}" if i != k % 250 else f"x{k}" for i in range(250))) for k in range(120)]
    for k in range(120, 160):
        words = [f"w{i}" for i in range(250)]
        for i in rng.choice(250, 6, replace=False):
            words[i] = f"y{k}"
        docs.append((k, " ".join(words)))
    sets = [set(shingles(t, 5)) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = labels(len(docs), pairs, [k for k, _ in docs])
    assert 2 < len(set(want)) < 45
    for block in (7, 30):
        decided = simhash_dedup.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), block=block)
        assert {r.doc_id: r.component_id for r in decided.collect()} == dict(zip((k for k, _ in docs), want))


def test_similar_pairs_in_runs_too_long_to_hold(spark, monkeypatch):
    """Pairs near the limit, each run of two already too long: all are still found."""
    monkeypatch.setattr(common, "ROWS_PER_BATCH", 1)
    rng = np.random.default_rng(8)
    docs = []
    for k in range(60):
        words = [f"w{k}_{i}" for i in range(250)]
        other = list(words)
        for i in rng.choice(250, 4, replace=False):
            other[i] = "x"
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    sets = [set(shingles(t, 5)) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = labels(len(docs), pairs, [k for k, _ in docs])
    assert len(pairs) > 40
    decided = simhash_dedup.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"), max_run=1)
    assert {r.doc_id: r.component_id for r in decided.collect()} == dict(zip((k for k, _ in docs), want))


@pytest.mark.parametrize("max_run", [1, 50])
def test_a_long_run_of_several_words_is_linked_whole(spark, max_run):
    rng = np.random.default_rng(4)
    flips = np.packbits(rng.random((300, 192)) < 0.05, axis=1).view(np.int64).reshape(-1, 3)
    sigs = flips ^ rng.integers(0, 1 << 62, 3)
    sigs[:, 0] = 5  # one run, and copies in it
    sigs[200:] = sigs[:100]
    distance = np.bitwise_count((sigs[:, None] ^ sigs[None]).view(np.uint64)).sum(2)
    pairs = [(i, int(j)) for i in range(300) for j in np.flatnonzero(distance[i] <= 7) if j > i]
    want = labels(300, pairs, list(range(300)))
    assert 20 < len(set(want)) < 180
    nodes = spark.createDataFrame([(k, s) for k, s in enumerate(sigs.tolist())], "id long, sig array<long>")
    probes = [(simhash_dedup.Mask(0, 0xFFFF),), (simhash_dedup.Mask(0, 0xFF0000),)]
    got = {r.node: r.component for r in components.connected_components(simhash_dedup.probed_links(nodes, probes, 3, 7, max_run)).collect()}
    assert [got.get(k, k) for k in range(300)] == want


def test_left_out_pairs_under_a_plan_of_many_words(spark, monkeypatch):
    """As for millions of documents: masks name words far beyond those that are compared."""
    wide = 21
    monkeypatch.setattr(simhash_dedup, "words_for", lambda *_: (wide, 4))
    monkeypatch.setattr(simhash_dedup, "recall_plan", lambda *_: [(simhash_dedup.Mask(w, 0xFF << 8 * k),) for w in range(wide) for k in (0, 3)])
    rng = np.random.default_rng(3)
    docs = []
    for k in range(60):
        words = [f"w{i}" for i in range(250)]
        for i in rng.choice(250, 4, replace=False):
            words[i] = f"x{k}"
        docs.append((k, " ".join(words)))
    sets = [set(shingles(t, 5)) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = labels(len(docs), pairs, [k for k, _ in docs])
    assert 1 < len(set(want)) < 60
    decided = simhash_dedup.similar_groups(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in decided.collect()} == dict(zip((k for k, _ in docs), want))


def test_unrelated_fingerprints_stay_apart():
    """Links by chance would grow into one family of everything as tables grow: 7000 unrelated fingerprints have none."""
    sigs = np.random.default_rng(5).integers(0, 1 << 64, (7000, simhash_dedup.CHECK_WORDS), dtype=np.uint64)
    tight, most = simhash_dedup._most_bits(simhash_dedup.CHECK_WORDS, 0.8)
    assert len(simhash_dedup._stars(sigs, most, tight)[0]) == 0


def test_small_sets_at_the_limit_stay_near():
    """Four of five shingles: ties of the majority make more bits differ than large sets of that similarity have."""
    assert simhash_dedup.widest_share(0.8) == pytest.approx(0.1875)
    _, most = simhash_dedup._most_bits(simhash_dedup.CHECK_WORDS, 0.8)
    hashes = np.random.default_rng(6).integers(0, 1 << 64, (3000, 5), dtype=np.uint64)
    x, y = (np.array([simhash_dedup.fingerprint(h[:k], simhash_dedup.CHECK_WORDS) for h in hashes]) for k in (4, 5))
    bits = np.bitwise_count(x ^ y).sum(1)
    assert bits.mean() == pytest.approx(64 * simhash_dedup.CHECK_WORDS * 0.1875, rel=0.02) and bits.max() <= most


@pytest.mark.parametrize("max_run", [1_000_000, 40])
def test_sizes_rule_pairs_out(spark, max_run):
    """Short, long and overflowing runs: no link between sets of too different sizes, all others as brute force has them."""
    rng = np.random.default_rng(7)
    base = rng.integers(-(1 << 63), 1 << 63, (30, 2))
    sigs = base[rng.integers(0, 30, 400)] ^ (1 << rng.integers(16, 63, (400, 2)))
    size = rng.integers(5, 60, 400)
    distance = np.bitwise_count((sigs[:, None] ^ sigs[None]).view(np.uint64)).sum(2)
    pairs = [(i, int(j)) for i in range(400) for j in np.flatnonzero(distance[i] <= 4) if j > i and min(size[i], size[j]) >= 0.8 * max(size[i], size[j])]
    want = labels(400, pairs, list(range(400)))
    assert 60 < len(set(want)) < 250
    nodes = spark.createDataFrame([(k, s, int(z)) for k, (s, z) in enumerate(zip(sigs.tolist(), size))], "id long, sig array<long>, size long")
    probes = [(simhash_dedup.Mask(0, 0xF),), (simhash_dedup.Mask(0, 0),)]
    links = simhash_dedup.probed_links(nodes, probes, 2, 4, max_run, alike=0.8)
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert [got.get(k, k) for k in range(400)] == want


def test_deduplicated_edges(spark):
    table = spark.createDataFrame([(*d, k) for k, d in enumerate(EDGES)], "doc_id long, text string, _node int")
    left = simhash_dedup.deduplicated(table)
    assert left.columns == ["doc_id", "text", "_node"]
    assert sorted((r.doc_id, len(r.text or "")) for r in left.collect()) == [(5, 18), (7, 0), (10, 3), (11, 7), (12, 5), (13, 5), (14, 100_000)]
    assert simhash_dedup.deduplicated(table.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(k, k + 1) for k in range(400, 460)]
    edges = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "a long, b long")
    want = labels(500, pairs, list(range(500)))
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {k: want[k] for k in range(500) if any(k in p and p[0] != p[1] for p in pairs)}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_components_of_dense_edges(spark, monkeypatch):
    """Tasks thin their edges in parts (words as nodes, repeated and reversed edges); components stay as brute force has them."""
    monkeypatch.setattr(components, "FOREST_EDGES", 64)
    rng = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 40, (900, 2))] + [(int(a), int(b)) for a, b in rng.integers(40, 400, (150, 2))]
    pairs += [(b, a) for a, b in pairs[:200]]
    want = labels(400, pairs, list(range(400)))
    edges = spark.createDataFrame([(f"{a:03}", f"{b:03}") for a, b in pairs], "a string, b string")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {f"{k:03}": f"{want[k]:03}" for k in range(400) if any(k in p and p[0] != p[1] for p in pairs)}
    thin = components._thinned(edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).coalesce(1))
    assert thin.count() < 600


def expected_vectors(rows, limit=0.98):
    unit = []
    for key, label, v in rows:
        ok = key is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if ok else None)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and rows[i][1] == rows[j][1] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= limit]
    links = np.bincount(np.array(pairs, int).ravel(), minlength=len(rows))
    component = labels(len(rows), pairs, [r[0] for r in rows])
    return sorted(((r[0], int(n), c, None if r[0] is None else r[0] == c) for r, n, c in zip(rows, links, component)), key=repr)


def test_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 6))
    rows = [(k, int(rng.integers(3)), [float(np.float32(x)) for x in centres[rng.integers(30)] + rng.normal(size=6) * 0.12]) for k in range(700)]
    rows += [(2000, None, [1.0] * 6), (2001, 0, None), (2002, 0, [0.0] * 6), (2003, 0, [float("nan")] + [1.0] * 5), (2004, 0, [None] + [1.0] * 5), (None, 0, [1.0] * 6), (2005, 0, []), (2006, 0, [1.0, 1.0]), (2007, 0, [2.0, 2.0]), (2008, 0, [float("inf")] * 6)]
    rows += [(3000 + k, 1, rows[9][2]) for k in range(5)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, n_links string")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table).collect()), key=repr)
    assert got == expected_vectors(rows)
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_vectors_query(spark, small):
    assert harness.difference(queries.op9_embedding_dedup(spark, small), small, queries.oracle_sql()["op9_embedding_dedup"]) == ""


def test_pruned_comparison_is_exact():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 32))
    b = np.concatenate([a[:50] + rng.normal(size=(50, 32)) * 0.1, rng.normal(size=(100, 32))])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    turn = np.linalg.qr(rng.normal(size=(32, 32)))[0]
    u, v = embedding_dedup._compare(a, b, a @ turn, b @ turn, 0.98, False)
    assert sorted(zip(u.tolist(), v.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.98))))


def test_salted_look_up(spark, monkeypatch):
    from entigraph.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    table = spark.createDataFrame([(0, "a"), (1, "b"), (None, "c")], "k long, v string")
    assert {(r.k, r.v, r.n) for r in common.looked_up(rows, table, "k", F.col("id")).groupBy("k", "v").agg(F.count("id").alias("n")).collect()} == {(0, "a", 334), (1, "b", 333), (2, None, 333)}
