"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint is one or more 64-bit words; a bit is 1 if it is set in over half
of the document's shingle hashes.  Bits of a word are grouped into parts so
that correlated bits stand together.  A pair within ``radius`` differing bits
must differ in at most t_i bits of some part i whenever the thresholds t_i (-1:
part unused) satisfy sum(t_i + 1) = radius + 1.  Dynamic programming chooses
the unequal thresholds of least estimated cost: probe rows, plus candidates
estimated from the joint bit counts of all fingerprints.  A part with threshold
t is probed by the fingerprint under every mask that leaves out t of its bits;
fingerprints that agree under a mask meet in one sorted run, where they are
compared in numpy tiles.  Only a minimum spanning forest of the verified links
of a run leaves it, so copies never expand to all pairs.

Two modes:

* ``fingerprint_groups``: exact by Hamming distance (one word, radius up to 3).
* ``similar_groups``: Jaccard similarity of shingle sets.  A pair at the limit
  differs in a known share of bits, too many for a guaranteed radius; the same
  programme then chooses thresholds so that such a pair is missed with at most
  ``miss`` probability, over several words.  What is probed are rows of a key,
  a number, four fingerprint words and a size; their links make families, and within a
  family every pair that may still join two groups is decided on the shingle
  sets, which travel once (in pairs of blocks if a family is long).

Defined results: a null text is an empty one; texts without words have the
fingerprint 0 and are copies of each other; fewer words than a shingle make one
shingle; repeated rows are members of one group; null ids are allowed and never
name a group that has another id; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entigraph.llm.common import BROADCAST_ROWS, free_name, looked_up, map_batches
from entigraph.llm.components import connected_components, minimum_forest
from entigraph.plans.workspace import removed, saved

SEED = 42
#: Rows of a run that one task holds (8 bytes a word each); a longer run is dealt anew: by all pairs of left-out bits (one word), or in pairs of blocks.
MAX_RUN = 2_000_000
#: Blocks that would hold MAX_RUN rows, when a longer run is dealt in pairs of blocks.
_RUN_BLOCKS = 8
#: Fingerprint words by which rows that meet under a probe are compared, when similar sets are looked for.  With two, some
#: unrelated texts are near by chance, and beyond some 200 000 texts such links grow into one family of texts that aren't alike.
CHECK_WORDS = 4
#: Shingles of sets that are small enough for ties of a majority to count.
_SMALL_SET = 16
#: Texts of a family that are compared in one task, with their shingle sets; a longer family is dealt in pairs of blocks.
BLOCK_ROWS = 8_000
#: Rounds in which a long family is drawn together by a few links of each group before its blocks meet.
HOOK_ROUNDS = 2
#: Rows of a run that are compared step by step with others of their size, and pairs that are compared at once.
_SMALL, _TILE = 64, 1 << 20
_BLOCK = 1 << 16
#: Differing bits of a pair whose sizes rule out the similarity.
_FAR = 0xFFFF
#: Relative costs of a shuffled probe row and of a compared pair.
_ROW, _PAIR = 1.0, 0.005


# -- fingerprints ------------------------------------------------------------


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of all shingles, repeats included."""
    from xxhash import xxh64_intdigest as digest

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, words: int = 1) -> np.ndarray:
    """``words`` 64-bit words: of the hashes themselves, then of hashes derived from them."""
    out = np.zeros(words, np.uint64)
    if not len(hashes):
        return out
    for k in range(words):
        h = hashes if k == 0 else _mixed(hashes, k)
        ones = np.zeros(64, np.int64)
        for a in range(0, len(h), 8192):
            bits = np.unpackbits(h[a : a + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            ones += (np.ones(len(bits), np.float32) @ bits).astype(np.int64)  # exact: at most 8192
        out[k] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """A second hash from the first: the finaliser of a split-mix generator, k steps on."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


# -- planning ----------------------------------------------------------------


class Mask(NamedTuple):
    word: int
    bits: int  # unsigned, of 64 bits


#: Fingerprints meet if they agree under all masks of a probe.
Probe = tuple[Mask, ...]


def joint_bits(nodes: DataFrame, words: int) -> np.ndarray:
    """How many fingerprints have bits i and j set, for each word: shape (words, 64, 64); counted over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((words, 64, 64))
        for batch in batches:
            sigs = _signatures(batch.column(0), words)
            for w in range(words):
                bits = _bits(sigs[:, w]).astype(np.float32)
                total[w] += bits.T @ bits
        w, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((w, pa.int32()), (i, pa.int32()), (j, pa.int32()), (total[w, i, j], pa.float64()))], ["w", "i", "j", "n"])

    out = np.zeros((words, 64, 64))
    for r in map_batches(nodes.select("sig"), work, "w int, i int, j int, n double").groupBy("w", "i", "j").agg(F.sum("n").alias("n")).collect():  # 4096 rows a word
        out[r["w"], r["i"], r["j"]] = r["n"]
    return out


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def grouped_bits(joint: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """The 64 bits in ``parts`` groups, correlated bits together (bit 0 is the highest)."""
    p = np.diag(joint) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(joint / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    left, groups = list(range(64)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(left, key=lambda b: (related[b, left].max(), -b))
        group = [seed]
        left.remove(seed)
        while len(group) < size:
            best = max(left, key=lambda b: (related[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def match_rates(joint: np.ndarray, n: int, group: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0, 1, .. ``most`` bits of a group: a chain of pairwise bit statistics."""
    n = max(n, 1)
    p = np.diag(joint) / n
    agree = p**2 + (1 - p) ** 2
    both, odds = float(agree[group[0]]), [float((1 - agree[group[0]]) / agree[group[0]])]
    for a, b in itertools.pairwise(group):
        p11 = joint[a, b] / n
        p10, p01 = p[a] - p11, p[b] - p11
        together = p11**2 + p10**2 + p01**2 + (1 - p11 - p10 - p01) ** 2
        both *= together / agree[a]
        odds.append(float((1 - agree[b]) / agree[b]))
    terms = [1.0]  # elementary symmetric sums of the odds
    for o in odds:
        terms = [1.0, *(terms[k] + o * terms[k - 1] for k in range(1, len(terms))), o * terms[-1]][: most + 1]
    return [min(1.0, both * sum(terms[: t + 1])) for t in range(most + 1)]


def _cost(n: int, group: list[int], rates: list[float], t: int) -> float:
    if t < 0:
        return 0.0
    return n * math.comb(len(group), t) * _ROW + n * n / 2 * rates[t] * _PAIR


def radius_plan(joint: np.ndarray, n: int, radius: int) -> list[Probe]:
    """Probes that bring together every pair of one-word fingerprints within ``radius``."""
    best: tuple[float, list[Probe]] | None = None
    for parts in range(1, radius + 3):
        groups = grouped_bits(joint, n, parts)
        rates = [match_rates(joint, n, g, radius) for g in groups]
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # spent sum of t + 1 -> cost, thresholds
        for group, rate in zip(groups, rates):
            after: dict[int, tuple[float, list[int]]] = {}
            for spent, (cost, chosen) in table.items():
                for t in range(-1, radius - spent + 1):
                    option = (cost + _cost(n, group, rate, t), [*chosen, t])
                    if option < after.get(spent + t + 1, (math.inf, [])):
                        after[spent + t + 1] = option
            table = after
        cost, thresholds = table[radius + 1]
        if best is None or cost < best[0]:
            best = cost, [p for g, t in zip(groups, thresholds) for p in _probes(0, g, t)]
    return best[1]


def _probes(word: int, group: list[int], t: int) -> list[Probe]:
    if t < 0:
        return []
    return [(Mask(word, sum(1 << (63 - b) for b in group if b not in out)),) for out in map(set, itertools.combinations(group, t))]


def differing_share(similarity: float) -> float:
    """Share of fingerprint bits that differ at a Jaccard similarity, for sets of equal size."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


@functools.cache
def widest_share(similarity: float) -> float:
    """The largest share of bits that differ on average between sets of at least that similarity, those of few shingles counted exactly."""

    def chances(k: int) -> list[float]:  # of 0 to k set bits
        return [math.comb(k, i) / 2**k for i in range(k + 1)]

    def differing(shared: int, a: int, b: int) -> float:  # a and b: shingles of one set only
        out = 0.0
        for s, p in enumerate(chances(shared)):
            x = sum(q for i, q in enumerate(chances(a)) if 2 * (s + i) > shared + a)
            y = sum(q for i, q in enumerate(chances(b)) if 2 * (s + i) > shared + b)
            out += p * (x * (1 - y) + y * (1 - x))
        return out

    few = [(s, a, b) for s in range(_SMALL_SET + 1) for a in range(_SMALL_SET - s + 1) for b in range(a, _SMALL_SET - s + 1)]
    return max(differing_share(similarity), *(differing(*f) for f in few if sum(f) and f[0] >= similarity * sum(f)))


def _most_bits(words: int, similarity: float) -> tuple[int, int]:
    """Differing bits that a pair at the similarity has on average, and those four and a half standard deviations beyond the most that small sets have."""
    bits, share = 64 * words, widest_share(similarity)
    return round(bits * differing_share(similarity)), round(bits * share + 4.5 * math.sqrt(bits * share * (1 - share)))


def words_for(n: int, similarity: float, miss: float) -> tuple[int, int]:
    """Fingerprint words, and parts of each word, of least estimated cost for ``n`` fingerprints of unrelated bits."""
    p, best = differing_share(similarity), None
    for parts in range(2, 9):
        bits = 64 // parts
        hit = (1 - p) ** bits
        needed = math.ceil(math.log(miss) / math.log(1 - hit))
        words = -(-needed // parts)
        cost = needed * n * (_ROW + words * 0.1) + needed * n * n / 2 / 2**bits * _PAIR
        if best is None or cost < best[0]:
            best = cost, words, parts
    return best[1], best[2]


def recall_plan(joint: np.ndarray, n: int, parts: int, similarity: float, miss: float) -> list[Probe]:
    """Thresholds -1, 0 or 1 of least cost such that a pair at the limit is missed with at most ``miss`` probability."""
    p = differing_share(similarity)
    units = 2000
    unit = -math.log(miss) / units
    table: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for word in range(len(joint)):
        for group in grouped_bits(joint[word], n, parts):
            rates, b = match_rates(joint[word], n, group, 1), len(group)
            options = [(0, 0.0, None)]
            for t in (0, 1):
                hit = (1 - p) ** b + t * b * p * (1 - p) ** (b - 1)
                options.append((int(-math.log(1 - hit) / unit), _cost(n, group, rates, t), (word, group, t)))
            after: dict[int, tuple[float, tuple]] = {}
            for had, (cost, chosen) in table.items():
                for gain, more, what in options:
                    got, total = min(units, had + gain), cost + more
                    if got not in after or total < after[got][0]:
                        after[got] = total, ((chosen, what) if what else chosen)
            table = after
    _, chosen = table[max(table)]
    out: list[Probe] = []
    while chosen:
        chosen, (word, group, t) = chosen
        out += _probes(word, group, t)
    return out


# -- probing and verifying ---------------------------------------------------


def _signatures(column: pa.Array, words: int) -> np.ndarray:
    return np.asarray(column.flatten()).view(np.uint64).reshape(-1, words)


def _distances(x: np.ndarray, y: np.ndarray, alike: float = 0.0) -> np.ndarray:
    """Differing bits of every row of ``x`` and every row of ``y``.

    With ``alike`` the last column isn't a word but the size of a set, and
    pairs whose sizes rule out that similarity are infinitely far.
    """
    words = x.shape[1] - (alike > 0)
    out = sum(np.bitwise_count(x[:, None, k] ^ y[None, :, k]).astype(np.uint16) for k in range(words))
    if alike > 0:
        a, b = x[:, -1].astype(float), y[:, -1].astype(float)
        out[(a[:, None] < alike * b[None, :]) | (b[None, :] < alike * a[:, None])] = _FAR
    return out


def _stars(sigs: np.ndarray, most: int, tight: int = -1, first: int | None = None, alike: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``most`` bits among the rows of one run, and their distances.

    A row is compared with the later rows and linked to one of each other tree
    that it reaches; once all rows are one tree nothing is left to compare, so
    copies of one text cost one comparison each.  Rows that reach nothing are
    taken in ever larger tiles.  Links within ``tight`` bits are taken before
    others.  With ``first`` only the links between the first so many rows and
    the others count.
    """
    n = len(sigs)
    tree, left, found = np.arange(n), n, [np.zeros((3, 0), np.int64)]
    end = n if first is None else first
    for limit in (tight, most) if 0 <= tight < most else (most,):
        i, step = 0, 1
        while i < end and left > 1:
            stop, start = min(end, i + step), i + 1 if first is None else first
            distance = _distances(sigs[i:stop], sigs[start:], alike)
            near = (distance <= limit) & (tree[i:stop, None] != tree[None, start:])
            if first is None:
                near &= np.tri(*near.shape, k=-1, dtype=bool) == 0
            rows = np.flatnonzero(near.any(1))
            for k in rows:
                j = np.flatnonzero(near[k])
                j = j[tree[start + j] != tree[i + k]]
                trees, one = np.unique(tree[start + j], return_index=True)
                found.append(np.stack([np.full(len(one), i + k), start + j[one], distance[k, j[one]].astype(np.int64)]))
                tree[np.isin(tree, trees)] = tree[i + k]
                left -= len(one)
            i, step = stop, max(1, step // 4) if len(rows) else min(2 * step, max(1, _TILE // n))
    u, v, w = np.concatenate(found, axis=1)
    return u, v, w


def _links(run: np.ndarray, sigs: np.ndarray, most: int, tight: int = -1, alike: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forest links of many complete runs, and their distances; ``run`` numbers them in order."""
    begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(begins, len(run)))
    place = np.arange(len(run)) - np.repeat(begins, sizes)
    size = np.repeat(sizes, sizes)
    found, words = [np.zeros((3, 0), np.int64)], sigs.shape[1] - (alike > 0)
    for d in range(1, min(_SMALL, int(sizes.max(initial=1)))):
        left = np.flatnonzero((place + d < size) & (size <= _SMALL))
        if not len(left):
            break
        x, y = sigs[left], sigs[left + d]
        distance = np.bitwise_count((x ^ y)[:, :words]).sum(1, dtype=np.int64)
        near = distance <= most
        if alike > 0:
            near &= np.minimum(x[:, -1], y[:, -1]) >= alike * np.maximum(x[:, -1], y[:, -1])
        found.append(np.stack([left[near], left[near] + d, distance[near]]))
    short = np.concatenate(found, axis=1)
    out = [short[:, minimum_forest(len(run), *short)]]
    for k in np.flatnonzero(sizes > _SMALL):
        a, own = begins[k], sigs[begins[k] : begins[k] + sizes[k]]
        if len(own) ** 2 <= _TILE:
            distance = _distances(own, own, alike)
            u, v = np.nonzero((distance <= most) & np.tri(len(own), k=-1, dtype=bool).T)
            w = distance[u, v].astype(np.int64)
            keep = minimum_forest(len(own), u, v, w)
            u, v, w = u[keep], v[keep], w[keep]
        else:
            u, v, w = _stars(own, most, tight, alike=alike)
        out.append(np.stack([u + a, v + a, w]))
    u, v, w = np.concatenate(out, axis=1)
    return u, v, w


def probed_links(nodes: DataFrame, probes: list[Probe], words: int, most: int, max_run: int = MAX_RUN, tight: int = -1, alike: float = 0.0) -> DataFrame:
    """Links (a, b) between ``id`` of nodes that agree under a probe's mask and are within ``most`` bits, and their ``distance``.

    Columns of nodes: id, sig (array of longs); the masks may name any word, the
    first ``words`` are compared and no others travel.  With ``alike`` nodes
    have a ``size`` too, and pairs whose sizes rule out that similarity don't
    link; sizes travel behind the words.  A run of more than ``max_run`` rows isn't held: its rows come back as members of an overflow
    and are dealt anew, so that none of its links is lost.
    """
    parts = [F.struct(F.lit(k).alias("probe"), _key(p).alias("key")) for k, p in enumerate(probes)]
    compared, width = (F.concat(F.slice("sig", 1, words), F.array("size")), words + 1) if alike > 0 else (F.slice("sig", 1, words), words)
    rows = nodes.select("id", compared.alias("sig"), F.explode(F.array(*parts)).alias("p")).select("p.probe", "p.key", "id", "sig")
    dealt = rows.repartition("probe", "key").sortWithinPartitions("probe", "key")
    kind = dict(nodes.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        over: tuple | None = None  # the run that is being passed on
        n, limit = 0, _BLOCK
        names = ["a", "b", "distance", "probe", "key", "sig"]

        def links(table: pa.Table) -> pa.RecordBatch | None:
            if not len(table):
                return None
            probe, key = (np.asarray(table.column(c).combine_chunks()) for c in ("probe", "key"))
            run = np.cumsum(np.concatenate([[False], (probe[1:] != probe[:-1]) | (key[1:] != key[:-1])]))
            u, v, w = _links(run, _signatures(table.column("sig").combine_chunks(), width), most, tight, alike)
            ids = table.column("id").combine_chunks()
            nothing = pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v)), pa.array(w, pa.int32()), pa.array(np.full(len(u), -1), pa.int32()), *nothing], names)

        def passed_on(part: pa.RecordBatch) -> pa.RecordBatch:
            probe, key, ids, sig = part.columns
            return pa.RecordBatch.from_arrays([ids, ids, pa.nulls(len(ids), pa.int32()), probe, key, sig], names)

        for batch in batches:
            while batch is not None and batch.num_rows:
                if over is not None:
                    probe, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                    as_over = (probe == over[0]) & (key == over[1])
                    same = batch.num_rows if as_over.all() else int(as_over.argmin())
                    if same:
                        part = batch.slice(0, same)
                        yield passed_on(part)
                    if same == batch.num_rows:
                        break
                    over, batch = None, batch.slice(same)
                held.append(batch)
                n += batch.num_rows
                batch = None
                if n >= limit or n > max_run:
                    table = pa.Table.from_batches(held)
                    probe, key = (np.asarray(table.column(c).combine_chunks()) for c in ("probe", "key"))
                    last = len(table) - int(((probe != probe[-1]) | (key != key[-1]))[::-1].argmax()) if (probe != probe[-1]).any() or (key != key[-1]).any() else 0
                    if (done := links(table.slice(0, last))) is not None:
                        yield done
                    rest = table.slice(last)
                    held, n = rest.to_batches(), len(rest)
                    limit = max(_BLOCK, 2 * n)
                    if n > max_run:
                        over = (probe[-1], key[-1])
                        for part in held:
                            yield passed_on(part)
                        held, n = [], 0
        if held and (done := links(pa.Table.from_batches(held))) is not None:
            yield done

    found = saved(map_batches(dealt, work, f"a {kind}, b {kind}, distance int, probe int, key bigint, sig array<bigint>"), "links")
    over = found.where("probe >= 0")
    if over.isEmpty():
        return found.select("a", "b", "distance")
    return found.where("probe < 0").select("a", "b", "distance").unionByName(_overflow_links(over, words, most, max_run, alike))


def _key(probe: Probe) -> Column:
    masked = [F.col("sig")[m.word].bitwiseAND(F.lit(_signed(m.bits))) for m in probe]
    return masked[0] if len(masked) == 1 else F.xxhash64(*masked)


def _overflow_links(rows: DataFrame, words: int, most: int, max_run: int, alike: float = 0.0) -> DataFrame:
    """Links of runs too long to hold; columns of rows: a, probe, key, sig.

    One word: rows that agree after leaving out ``most`` bits are all within
    ``most``, so each links to the smallest of them, by an aggregate.  Several
    words: rows of the same fingerprint link to the smallest of them, and the
    different fingerprints of a run are compared block by block.
    """
    every = (1 << 64) - 1
    if words == 1 and not alike:
        exact = [(Mask(0, every & ~sum(1 << b for b in out)),) for out in itertools.combinations(range(64), most)]
        dealt = rows.select("a", F.posexplode(F.array(*map(_key, exact))).alias("which", "key"))
        low = dealt.groupBy("which", "key").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
        return dealt.join(low, ["which", "key"]).where("a <> b").select("a", "b").distinct().withColumn("distance", F.lit(most))
    low = rows.groupBy("sig").agg(F.min("a").alias("b"))
    same = rows.select("a", "sig").distinct().join(low, "sig").where("a <> b").select("a", "b", F.lit(0).alias("distance"))
    return same.unionByName(_block_links(rows, words + (alike > 0), most, max(1, max_run // _RUN_BLOCKS), alike))


def _block_links(rows: DataFrame, width: int, most: int, block: int, alike: float = 0.0) -> DataFrame:
    """Links within ``most`` bits of the different fingerprints of each run, the smallest ``a`` standing for those of one.

    A run is cut into blocks of about ``block`` rows, and every two of them
    meet in a cell of their own: no task holds more than two blocks, and the
    forests of all cells join what the forest of the whole run would.
    """
    kind = dict(rows.dtypes)["a"]
    nodes = saved(rows.groupBy("probe", "key", "sig").agg(F.min("a").alias("id")), "long-runs")
    runs = nodes.groupBy("probe", "key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    nodes = nodes.join(F.broadcast(runs), ["probe", "key"])  # a row for each of the few runs too long to hold
    nodes = nodes.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    nodes = nodes.select("probe", "key", cell.alias("cell"), "own", (F.col("own") == F.col("other")).alias("same"), "id", "sig")
    dealt = nodes.repartition("probe", "key", "cell").sortWithinPartitions("probe", "key", "cell", "own")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, limit = 0, _BLOCK

        def numbered(table: pa.Table) -> np.ndarray:
            columns = [np.asarray(table.column(c).combine_chunks()) for c in ("probe", "key", "cell")]
            return np.cumsum(np.concatenate([[False], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))

        def links(table: pa.Table, run: np.ndarray) -> pa.RecordBatch:
            sigs, own = _signatures(table.column("sig").combine_chunks(), width), np.asarray(table.column("own").combine_chunks())
            diagonal, begins = np.asarray(table.column("same").combine_chunks()), np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            found = [np.zeros((3, 0), np.int64)]
            for a, b in zip(begins, np.append(begins[1:], len(run))):
                first = int(np.searchsorted(own[a:b], own[b - 1]))
                if first == 0 and not diagonal[a]:
                    continue  # one of the two blocks is empty
                u, v, w = _stars(sigs[a:b], most, first=first or None, alike=alike)
                found.append(np.stack([u + a, v + a, w]))
            u, v, w = np.concatenate(found, axis=1)
            ids = table.column("id").combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v)), pa.array(w, pa.int32())], ["a", "b", "distance"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < limit:
                continue
            table = pa.Table.from_batches(held)
            run = numbered(table)
            last = int(np.searchsorted(run, run[-1]))
            if last:
                yield links(table.slice(0, last), run[:last])
            held, n = table.slice(last).to_batches(), len(table) - last
            limit = max(_BLOCK, 2 * n)
        if n:
            table = pa.Table.from_batches(held)
            yield links(table, numbered(table))

    return map_batches(dealt, work, f"a {kind}, b {kind}, distance int").distinct()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


# -- groups ------------------------------------------------------------------


def fingerprints(docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``fp`` (long: the 64 bits)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(shingle_hashes(words_of(t), shingle))[0] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], [key, "fp"])

    return map_batches(docs.select(key, text), work, f"`{key}` {dict(docs.dtypes)[key]}, fp bigint")


def fingerprint_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text", max_run: int = MAX_RUN) -> DataFrame:
    """One row per document: key, ``fp`` and ``component_id``, the smallest key reachable over links of at most ``radius`` bits.

    Fingerprints are compared once, whatever the number of their documents.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius 0 to 3")
    rows = saved(fingerprints(docs, shingle, key, text), "fingerprints")
    nodes = saved(rows.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    ids = nodes.select(F.col("fp").alias("id"), F.array("fp").alias("sig"))
    probes = radius_plan(joint_bits(ids, 1)[0], nodes.count(), radius)
    groups = connected_components(probed_links(ids, probes, 1, radius, max_run))
    return _with_components(rows, nodes, groups, "fp", key)


def _with_components(rows: DataFrame, nodes: DataFrame, groups: DataFrame, node: str, key: str) -> DataFrame:
    """Rows with the smallest key of their component; only nodes with copies or links need a look-up."""
    linked = nodes.join(groups.withColumnRenamed("node", node), node, "left")
    root = F.coalesce("component", node)
    linked = saved(linked.where("n > 1 or component is not null").select(node, "first", root.alias("_root")), "linked-nodes")
    names = linked.groupBy("_root").agg(F.min("first").alias("_least"))
    table = saved(linked.join(names, "_root").select(node, "_least"), "linked-names")
    return looked_up(rows, table, node, F.col(key)).withColumn("component_id", F.coalesce("_least", key)).drop("_least")


def _node_of(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, miss: float = 0.002, key: str = "doc_id", text: str = "text", max_run: int = MAX_RUN, block: int = BLOCK_ROWS) -> DataFrame:
    """Written table, one row per document: key, ``node`` (16 bytes: which words it has), ``component_id``, ``kept``.

    Documents with the same words are one node; nodes link at a Jaccard
    similarity of ``shingle``-word sets of at least ``similarity``.  ``kept`` is
    true for the rows of the smallest key (then node) of each group.
    """
    rows_in = docs.select(key, text)
    words, parts = words_for(max(2, docs.count()), similarity, miss)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sig, size = [], [], []
            for t in batch.column(1).to_pylist():
                own = words_of(t)
                shingles = np.unique(shingle_hashes(own, shingle))
                node.append(_node_of(own))
                sig.append(fingerprint(shingles, max(words, CHECK_WORDS)).view(np.int64))
                size.append(len(shingles))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.binary()), pa.array(sig, pa.list_(pa.int64())), pa.array(size, pa.int64())], [key, "node", "sig", "size"])

    kind = dict(docs.dtypes)[key]
    rows = saved(map_batches(rows_in, work, f"`{key}` {kind}, node binary, sig array<bigint>, size long"), "signatures")
    nodes = rows.groupBy("node").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    nodes = saved(nodes.withColumn("id", F.monotonically_increasing_id()), "signature-nodes")  # numbers are written once and then read
    n, width = nodes.count(), max(words, CHECK_WORDS)
    probes = recall_plan(joint_bits(nodes, width)[:words], n, parts, similarity, miss)
    tight, most = _most_bits(CHECK_WORDS, similarity)
    found = probed_links(nodes, probes, CHECK_WORDS, most, max_run, tight, similarity)
    links = saved(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("distance")), "candidates")
    removed(found)
    groups = saved(_similar_components(docs, rows, nodes, n, links, shingle, similarity, key, text, block), "groups", n)
    linked = nodes.join(groups.withColumnRenamed("node", "id"), "id", "left").where("n > 1 or component is not null")
    linked = saved(linked.select("node", "first", F.coalesce("component", "id").alias("_root")), "linked-nodes", n)
    best = linked.groupBy("_root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("best"))
    table = saved(linked.join(best, "_root").select("node", F.col("best.first").alias("_least"), F.col("best.node").alias("_best")), "linked-names", n)
    done = looked_up(rows.drop("sig", "size"), table, "node", F.col(key))
    kept = F.col("_best").isNull() | ((F.col("node") == F.col("_best")) & F.col(key).eqNullSafe(F.col("_least")))
    component = F.when(F.col("_best").isNull(), F.col(key)).otherwise(F.col("_least"))
    out = saved(done.select(key, "node", component.alias("component_id"), kept.alias("kept")), "decided")
    removed(rows, nodes, links, groups, linked, table)
    return out


def _similar_components(docs: DataFrame, rows: DataFrame, nodes: DataFrame, n: int, links: DataFrame, shingle: int, similarity: float, key: str, text: str, block: int) -> DataFrame:
    """``node`` (an id) and ``component`` over links that hold on the shingle sets; there are ``n`` nodes.

    Candidate links make families.  A family of up to ``block`` nodes is
    compared whole.  A longer one is first drawn together: each of its groups
    tries a link to the smallest group that it reaches and the nearest one, for
    HOOK_ROUNDS rounds; what then still has candidate links to another group
    is compared in pairs of blocks, groups that are already one left out.
    """
    families = saved(connected_components(links), "families", n)
    sets = _shingle_sets(docs, rows, nodes.join(families.select(F.col("node").alias("id")), "id"), shingle, key, text)
    long = saved(families.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("component"), "long-families", n // block)
    members = families.join(_few(long), "component", "left_anti").select(F.col("node").alias("id"), F.col("node").alias("group"), F.col("component").alias("family"))
    similar = []
    if not long.isEmpty():
        of = families.join(_few(long), "component", "left_semi").select(F.col("node").alias("a"))
        inner = saved(links.join(of, "a", "left_semi"), "long-links")
        tried = inner.select("a", "b").limit(0)
        groups = families.limit(0).select("node", "component")
        for _ in range(HOOK_ROUNDS):
            left = _between(inner.join(tried, ["a", "b"], "left_anti"), groups)
            chosen = saved(_hooks(left), "hooks", 2 * n)
            similar.append(_verified(chosen, sets, similarity))
            tried = tried.unionByName(chosen)
            groups = saved(connected_components(_union(similar)), "hooked", n)
        apart = saved(_between(inner, groups), "apart")
        families = connected_components(apart.select(F.col("ga").alias("a"), F.col("gb").alias("b"))).select(F.col("node").alias("group"), F.col("component").alias("family"))
        mine = of.select(F.col("a").alias("id")).join(groups.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("group"))
        members = members.unionByName(mine.join(families, "group").select("id", "group", "family"))
    similar.append(saved(_family_links(saved(members, "members", n), nodes, sets, similarity, block), "similar"))
    return connected_components(_union(similar))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is short."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _between(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between different groups, with the groups ``ga`` and ``gb`` of their ends; a node without a group is its own."""
    for end, name in (("a", "ga"), ("b", "gb")):
        of = groups.select(F.col("node").alias(end), F.col("component").alias(name))
        links = links.join(of, end, "left").withColumn(name, F.coalesce(name, end))
    return links.where("ga <> gb")


def _hooks(links: DataFrame) -> DataFrame:
    """For each group its link to the smallest group that it reaches, and the one of the least distance."""
    ends = links.select("a", "b", "distance", F.explode(F.array(F.struct(F.col("ga").alias("g"), F.col("gb").alias("to")), F.struct(F.col("gb").alias("g"), F.col("ga").alias("to")))).alias("e"))
    chosen = ends.groupBy("e.g").agg(F.min(F.struct("e.to", "distance", "a", "b")).alias("low"), F.min(F.struct("distance", "e.to", "a", "b")).alias("near"))
    pairs = F.array(*(F.struct(F.col(f"{c}.a").alias("a"), F.col(f"{c}.b").alias("b")) for c in ("low", "near")))
    return chosen.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def _shingle_sets(docs: DataFrame, rows: DataFrame, wanted: DataFrame, shingle: int, key: str, text: str) -> DataFrame:
    """Written table of wanted nodes: id and shingles, as 32-bit hashes.

    Two different shingles of a pair of texts have one hash with a probability
    of 2**-32 each, which would shift the similarity by one shingle.
    """
    named = saved(wanted.select("node", "id", F.col("first").alias("_key")), "wanted")
    keys = _few(named.select("_key").distinct())
    texts = docs.select(key, text).join(keys, docs[key].eqNullSafe(F.col("_key")), "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sets = [], []
            for t in batch.column(1).to_pylist():
                own = words_of(t)
                node.append(_node_of(own))
                sets.append(np.unique((shingle_hashes(own, shingle) >> np.uint64(32)).astype(np.uint32)).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(sets, pa.list_(pa.int32()))], ["node", "shingles"])

    sets = map_batches(texts, work, "node binary, shingles array<int>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    return saved(sets.join(named.select("node", "id"), "node").select("id", "shingles"), "shingle-sets")


def _verified(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Written table: those of some written links whose shingle sets are similar enough."""
    few = _few(links)
    x = sets.join(few, sets["id"] == links["a"]).select("a", "b", F.col("shingles").alias("x"))
    y = sets.join(few, sets["id"] == links["b"]).select("a", "b", F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return saved(x.join(y, ["a", "b"]).where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"), "verified")


def _family_links(members: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) that join the groups of each family as all its similar pairs would; members is a written table of id, group, family.

    Rows of a family of more than ``block`` nodes are dealt to blocks, a group
    that fills one to blocks of its own, and every two blocks that aren't of one
    group meet in a cell: no task holds or compares more than two blocks.
    """
    size = members.groupBy("family").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    long = saved(size.where(F.col("n") > block).select("family"), "long-families")
    short = members.join(size.where(F.col("n") <= block).select("family"), "family").withColumns({"cell": F.lit(0).cast("long"), "own": F.lit(-1)})
    dealt = short if long.isEmpty() else short.unionByName(_in_cells(members.join(_few(long), "family", "left_semi"), block))
    full = dealt.join(nodes.select("id", F.slice("sig", 1, CHECK_WORDS).alias("sig")), "id").join(sets, "id")
    dealt = full.repartition("family", "cell").sortWithinPartitions("family", "cell", "own")
    _, most = _most_bits(CHECK_WORDS, similarity)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, limit = 0, block

        def numbered(table: pa.Table) -> np.ndarray:
            family, cell = (np.asarray(table.column(c).combine_chunks()) for c in ("family", "cell"))
            return np.cumsum(np.concatenate([[False], (family[1:] != family[:-1]) | (cell[1:] != cell[:-1])]))

        def links(table: pa.Table, run: np.ndarray) -> pa.RecordBatch:
            group, own = (np.asarray(table.column(c).combine_chunks()) for c in ("group", "own"))
            sigs, shingles = _signatures(table.column("sig").combine_chunks(), CHECK_WORDS), table.column("shingles").combine_chunks()
            values, ends = np.asarray(shingles.flatten()), np.concatenate([[0], np.cumsum(np.asarray(shingles.value_lengths()))])
            begins = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
            found = [np.zeros((2, 0), np.int64)]
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(run)]):
                first = int(np.searchsorted(own[a:b], own[b - 1])) or None  # two blocks: only their cross pairs count
                found.append(a + _similar_trees(values[ends[a] : ends[b]], ends[a : b + 1] - ends[a], sigs[a:b], group[a:b], similarity, most, first))
            u, v = np.concatenate(found, axis=1)
            ids = table.column("id").combine_chunks()
            return pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < limit:
                continue
            table = pa.Table.from_batches(held)
            run = numbered(table)
            last = int(np.searchsorted(run, run[-1]))
            if last:
                yield links(table.slice(0, last), run[:last])
            held, n = table.slice(last).to_batches(), len(table) - last
            limit = max(block, 2 * n)
        if n:
            table = pa.Table.from_batches(held)
            yield links(table, numbered(table))

    return map_batches(dealt.select("family", "cell", "own", "id", "group", "sig", "shingles"), work, "a long, b long")


def _in_cells(members: DataFrame, block: int) -> DataFrame:
    """Rows of long families once for each cell that they are in, with their block ``own``.

    The first blocks of a family hold small groups; each group of at least
    ``block`` rows has its own blocks behind them, which don't meet each other.
    """
    sizes = saved(members.groupBy("family", "group").agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    small = sizes.where(F.col("n") < block).groupBy("family").agg(F.ceil(F.sum("n") / block).cast("long").alias("shared"))
    families = sizes.select("family").distinct().join(small, "family", "left").select("family", F.coalesce("shared", F.lit(0)).alias("shared"))
    large = sizes.where(F.col("n") >= block).select("family", "group", F.ceil(F.col("n") / block).cast("long").alias("wide"))
    before = Window.partitionBy("family").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # a row for each ``block`` nodes, at most
    large = large.withColumn("at", F.coalesce(F.sum("wide").over(before), F.lit(0)))
    total = families.join(large.groupBy("family").agg(F.sum("wide").alias("wide")), "family", "left").select("family", "shared", (F.col("shared") + F.coalesce("wide", F.lit(0))).alias("blocks"))
    rows = members.join(_few(saved(large, "large-groups")), ["family", "group"], "left").join(_few(saved(total, "blocks")), "family")
    spread, big = F.xxhash64("id"), F.col("at").isNotNull()
    low, high = F.col("shared") + F.col("at"), F.col("shared") + F.col("at") + F.col("wide")
    own = F.when(big, low + F.pmod(spread, F.col("wide"))).otherwise(F.pmod(spread, F.greatest("shared", F.lit(1))))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    others = F.when(big, F.filter(every, lambda x: (x < low) | (x >= high))).otherwise(every)
    rows = rows.select("id", "group", "family", own.cast("int").alias("own"), "blocks", F.explode(others).alias("other"))
    cell = F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")
    return rows.select("family", "id", "group", cell.alias("cell"), "own")


def _similar_trees(values: np.ndarray, ends: np.ndarray, sigs: np.ndarray, group: np.ndarray, similarity: float, most: int, first: int | None) -> np.ndarray:
    """Places (u, v) of links that join groups as all similar pairs of sets would; ``ends`` bound the sets in ``values``.

    A row is compared with the later rows that aren't in one tree with it; with
    ``first`` only the pairs between the first so many rows and the others count.
    """
    names, codes = np.unique(values, return_inverse=True)
    _, tree = np.unique(group, return_inverse=True)
    size, n = np.diff(ends), len(sigs)
    left, mark, found = int(tree.max(initial=-1)) + 1, np.zeros(len(names), bool), [np.zeros((2, 0), np.int64)]
    for i in range(n if first is None else first):
        if left == 1:
            break
        start = i + 1 if first is None else first
        j = start + np.flatnonzero(tree[start:] != tree[i])
        j = j[np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i])]
        j = j[np.bitwise_count(sigs[j] ^ sigs[i]).sum(1, dtype=np.int64) <= most]
        if not len(j):
            continue
        mine = codes[ends[i] : ends[i + 1]]
        mark[mine] = True
        at = np.repeat(ends[j] - np.concatenate([[0], np.cumsum(size[j])[:-1]]), size[j]) + np.arange(size[j].sum())
        sums = np.concatenate([[0], np.cumsum(mark[codes[at]])])
        mark[mine] = False
        shared = np.diff(sums[np.concatenate([[0], np.cumsum(size[j])])])
        j = j[shared >= similarity * (size[j] + size[i] - shared)]
        if len(j):
            trees, one = np.unique(tree[j], return_index=True)
            found.append(np.stack([np.full(len(one), i), j[one]]))
            tree[np.isin(tree, trees)] = tree[i]
            left -= len(one)
    return np.concatenate(found, axis=1)


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all their columns, one of each group of similar ones: the row of the smallest key."""
    decided = similar_groups(docs, shingle, similarity, key=key, text=text)
    out = saved(decided.where(~F.col("kept")).select(F.col(key).alias("_key"), F.col("node").alias("_node")).distinct(), "dropped")
    twice = saved(decided.where("kept").groupBy(F.col(key).alias("_key"), F.col("node").alias("_node")).count().where("count > 1").drop("count"), "repeated")
    removed(decided)
    columns, at, own = docs.columns, docs.columns.index(text), free_name(docs.columns, "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = pa.array([_node_of(words_of(t)) for t in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, node], [*batch.schema.names, own])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes), f"`{own}` binary"])
    named = map_batches(docs, work, schema)

    def same(table: DataFrame) -> Column:
        return named[key].eqNullSafe(table["_key"]) & (named[own] == table["_node"])

    out = _few(out)
    left = named.join(out, same(out), "left_anti")
    if not twice.isEmpty():
        twice = _few(twice)
        single = left.join(twice, same(twice), "left_anti")
        left = single.unionByName(left.join(twice, same(twice), "left_semi").dropDuplicates([key, own]))
    return left.select(*columns)
