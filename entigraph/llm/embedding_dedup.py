"""Embedding near-duplicates by PCA-ordered tiled comparison.

Equal vectors of a label are one node.  Nodes are rotated onto the principal
axes of all vectors, ordered by their leading coordinates within each label and
dimension, and cut into tiles.  Unit vectors at the limit are at most
sqrt(2 - 2 limit) apart, so two tiles meet only if the boxes of their leading
coordinates are that near.  Within a pair of tiles the products of the leading
coordinates are accumulated first; what the rest can add is bounded by the
norms of the suffixes, and a pair whose bound cannot reach the limit is
stopped.  Pairs that remain are decided by the cosine of the original vectors
in double precision.

A pair of tiles returns the number of links of each node, weighted by copies,
and a spanning forest of its links, never the links themselves.

Defined results: a vector that is null, empty, zero, or holds a null or a
non-finite component, and one without a label or an id, links with nothing; it
keeps its id as component and is kept (without an id: component and kept are
null).  Vectors of different dimensions don't link.  Repeated rows are copies
that link with each other; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entigraph.llm.common import looked_up, map_batches
from entigraph.llm.components import connected_components, minimum_forest
from entigraph.plans.workspace import saved

#: Vectors of a tile: with 64 single-precision components a quarter of a megabyte.
TILE = 1024
#: Leading coordinates by which tiles are ordered, and those of their boxes.
_ORDER, _BOX = 4, 8
#: Coordinates that have been accumulated before each test of the bound, as shares of the dimension.
_STAGES = (1 / 8, 3 / 8)
#: What rounding may add to a bound.
_SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Whether a vector can link: present, finite throughout, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def axes(nodes: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes (columns, leading first) of the unit vectors of each dimension, from sums over all of them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(0)
            sizes = np.diff(np.asarray(vectors.offsets))
            for d in np.unique(sizes).tolist():
                x = _unit(np.asarray(vectors.filter(pa.array(sizes == d)).flatten(), np.float64).reshape(-1, d))
                sums[d] = sums.get(d, 0) + x.T @ x
        for d, total in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["d", "i", "j", "s"])

    out: dict[int, np.ndarray] = {}
    for r in map_batches(nodes.select("vector"), work, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).collect():  # d * d / 2 rows a dimension
        out.setdefault(r["d"], np.zeros((r["d"], r["d"])))[[r["i"], r["j"]], [r["j"], r["i"]]] = r["s"]
    return {d: np.linalg.eigh(c)[1][:, ::-1].copy() for d, c in out.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of tiny or huge components stay in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _tiles(nodes: DataFrame, rotation: dict[int, np.ndarray], step: float) -> DataFrame:
    """Written tiles: tile (string), label, d, lows and highs of the box, ids, weights, vectors (flat)."""

    def coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            sizes = np.diff(np.asarray(vectors.offsets))
            lead = np.zeros((batch.num_rows, _BOX))
            for d in np.unique(sizes).tolist():
                own = sizes == d
                x = _unit(np.asarray(vectors.filter(pa.array(own)).flatten(), np.float64).reshape(-1, d)) @ rotation[d][:, :_BOX]
                lead[own, : x.shape[1]] = x
            cells = np.floor(lead[:, :_ORDER] / step).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(list(cells), pa.list_(pa.int32())), pa.array(list(lead), pa.list_(pa.float64()))], [*batch.schema.names, "d", "cells", "lead"])

    kinds = dict(nodes.dtypes)
    placed = map_batches(nodes, coordinates, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", d int, cells array<int>, lead array<double>")
    placed = placed.withColumn("first", F.col("lead")[0])
    order = ["label", "d", "cells", "first"]
    # Ranges are cut anywhere, so a label that holds most vectors is spread over many tasks.
    dealt = saved(placed, "coordinates").repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        def tile(table: pa.Table) -> pa.RecordBatch:
            lead = np.asarray(table.column("lead").combine_chunks().flatten()).reshape(-1, _BOX)
            one = [uuid.uuid4().hex, table.column("label")[0].as_py(), table.column("d")[0].as_py(), lead.min(0), lead.max(0), table.column("id").to_pylist(), table.column("n").to_pylist(), np.asarray(table.column("vector").combine_chunks().flatten())]
            types = [pa.string(), table.schema.field("label").type, pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(table.schema.field("vector").type.value_type)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(one, types)], ["tile", "label", "d", "lows", "highs", "ids", "weights", "vectors"])

        held, of = [], None
        for batch in batches:
            labels, sizes = batch.column("label").to_pylist(), batch.column("d").to_pylist()
            a = 0
            for k in range(batch.num_rows):
                if (labels[k], sizes[k]) != of or sum(len(x) for x in held) + k - a >= TILE:
                    if k > a:
                        held.append(batch.slice(a, k - a))
                    if held:
                        yield tile(pa.Table.from_batches(held))
                    held, of, a = [], (labels[k], sizes[k]), k
            held.append(batch.slice(a))
        if any(len(x) for x in held):
            yield tile(pa.Table.from_batches(held))

    element = kinds["vector"]
    schema = f"tile string, label {kinds['label']}, d int, lows array<double>, highs array<double>, ids array<string>, weights array<bigint>, vectors {element}"
    return saved(map_batches(dealt, cut, schema), "tiles")


def _compare(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, limit: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs with a cosine of at least ``limit``; a, b unit rows, ra, rb the same rotated."""
    d = a.shape[1]
    product, done, alive = np.zeros((len(a), len(b))), 0, None
    for share in _STAGES:
        upto = max(done + 1, min(d, math.ceil(d * share)))
        if upto >= d:
            break
        product += ra[:, done:upto] @ rb[:, done:upto].T
        done = upto
        rest_a, rest_b = (np.sqrt(np.maximum(0, (x[:, done:] ** 2).sum(1))) for x in (ra, rb))
        alive = product + np.outer(rest_a, rest_b) >= limit - _SLACK
        n = int(alive.sum())
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n * 16 < alive.size:
            break  # few enough to finish pair by pair
    if alive is None or int(alive.sum()) * 16 >= alive.size:
        cosine = a @ b.T
        near = cosine >= limit
        if same:
            near &= np.tri(len(a), k=-1, dtype=bool).T
        return np.nonzero(near)
    u, v = np.nonzero(alive)
    if same:
        u, v = u[u < v], v[u < v]
    keep = [np.einsum("ij,ij->i", a[u[k : k + 65536]], b[v[k : k + 65536]]) >= limit for k in range(0, len(u), 65536)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return u[keep], v[keep]


def _compared(tiles: DataFrame, rotation: dict[int, np.ndarray], limit: float, gap: float) -> DataFrame:
    """Written results of all pairs of near tiles: (a, null, links of a) and (a, b, null) for forest links."""
    width = F.lit(gap)
    meta = tiles.select("tile", "label", "d", "lows", "highs")
    # An interval join on the first axis: tiles share a cell of the width of the gap, or touch the next one.
    cells = F.sequence(F.floor((F.col("lows")[0] - width) / width), F.floor((F.col("highs")[0] + width) / width))
    cell = meta.withColumn("cell", F.explode(cells))
    right = cell.select(*(F.col(c).alias(f"{c}_") for c in cell.columns))
    gaps = [F.greatest(F.lit(0.0), F.col("lows")[k] - F.col("highs_")[k], F.col("lows_")[k] - F.col("highs")[k]) for k in range(_BOX)]
    apart = functools.reduce(operator.add, [g * g for g in gaps])
    near = cell.join(right, (F.col("label") == F.col("label_")) & (F.col("d") == F.col("d_")) & (F.col("cell") == F.col("cell_")) & (F.col("tile") <= F.col("tile_")))
    pairs = near.where(apart <= gap * gap + _SLACK).select("tile", "tile_").distinct()
    body = tiles.select("tile", "d", "ids", "weights", "vectors")
    both = pairs.join(body, "tile").join(body.select(*(F.col(c).alias(f"{c}_") for c in body.columns if c != "d")), "tile_")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                d, same = row["d"].as_py(), row["tile"].as_py() == row["tile_"].as_py()
                a, b = (_unit(np.asarray(row[c].values, np.float64).reshape(-1, d)) for c in ("vectors", "vectors_"))
                u, v = _compare(a, b, a @ rotation[d], b @ rotation[d], limit, same)
                if not len(u):
                    continue
                ids, ids_ = np.array(row["ids"].as_py(), object), np.array(row["ids_"].as_py(), object)
                w, w_ = np.asarray(row["weights"].values), np.asarray(row["weights_"].values)
                n, n_ = np.bincount(u, w_[v], len(ids)).astype(np.int64), np.bincount(v, w[u], len(ids_)).astype(np.int64)
                shift = 0 if same else len(ids)
                keep = minimum_forest(len(ids) + len(ids_), u, v + shift, np.zeros(len(u)))
                left = np.concatenate([ids[n > 0], ids_[n_ > 0], ids[u[keep]]])
                right = np.concatenate([np.full((n > 0).sum() + (n_ > 0).sum(), None, object), ids_[v[keep]]])
                count = [*n[n > 0].tolist(), *n_[n_ > 0].tolist(), *[None] * len(keep)]
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(count, pa.int64())], ["a", "b", "n"])

    dealt = both.repartition("tile", "tile_")
    return saved(map_batches(dealt, work, "a string, b string, n bigint"), "compared")


def near_duplicates(vectors: DataFrame, limit: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.  Limits from 0.5 to below 1."""
    if not 0.5 <= limit < 1:
        raise ValueError("limit: a cosine of at least 0.5 and less than 1")
    gap = math.sqrt(2 - 2 * limit)
    rows = vectors.select(F.col(key).alias("_key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    rows = rows.withColumn("_can", usable(F.col("vector")) & F.col("label").isNotNull() & F.col("_key").isNotNull())
    digest = F.md5(F.concat(F.md5(F.col("label").cast("string")), F.md5(F.concat_ws(",", F.col("vector").cast("array<string>")))))
    rows = rows.withColumn("id", F.when(F.col("_can"), digest))
    can = rows.where("_can")
    nodes = saved(can.groupBy("id").agg(F.min("_key").alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector")), "vectors")
    rotation = axes(nodes)
    tiles = _tiles(nodes.select("id", "label", "n", "vector"), rotation, gap)
    found = _compared(tiles, rotation, limit, gap)
    links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links"))
    groups = connected_components(found.where("b is not null").select("a", "b"))
    joined = nodes.select("id", "least", "n").join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    linked = saved(joined.where("n > 1 or links is not null").withColumn("root", F.coalesce("component", "id")), "linked-vectors")
    least = linked.groupBy("root").agg(F.min("least").alias("_least"))
    table = linked.join(least, "root").select("id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("_links"), "_least")
    done = looked_up(rows.select("_key", "id"), saved(table, "linked-components"), "id", F.col("_key"))
    component = F.coalesce("_least", "_key")
    return done.select(F.col("_key").alias(key), F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("_key") == component).alias("kept"))
