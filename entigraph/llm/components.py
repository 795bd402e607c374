"""Connected components: a numpy kernel for one batch and a distributed one for whole tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from entigraph.llm.common import map_batches
from entigraph.plans.workspace import removed, saved

#: Edges that a task holds while it thins its own to a forest.
FOREST_EDGES = 1 << 20


def merged_labels(labels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest label of each component after joining ``u`` with ``v``; ``labels`` points at smaller or own places."""
    labels = labels.copy()
    while True:
        a, b = labels[u], labels[v]
        apart = a != b
        if not apart.any():
            return labels
        u, v = u[apart], v[apart]
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(labels, high, low)
        while True:
            nearer = labels[labels]
            if (nearer == labels).all():
                break
            labels = nearer


def minimum_forest(n: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest (Boruvka; ties by place)."""
    labels = np.arange(n)
    chosen: list[np.ndarray] = []
    order = np.argsort(weight, kind="stable")
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    alive = np.arange(len(u))
    while len(alive):
        a, b = labels[u[alive]], labels[v[alive]]
        apart = a != b
        alive, a, b = alive[apart], a[apart], b[apart]
        if not len(alive):
            break
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, a, position[alive])
        np.minimum.at(best, b, position[alive])
        picked = order[np.unique(best[best < np.iinfo(np.int64).max])]
        chosen.append(picked)
        labels = merged_labels(labels, u[picked], v[picked])
    return np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.int64)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for every node that has an edge.

    Alternating large-star and small-star steps: each round only regroups and
    joins edges on a node, so no component is ever gathered in one place; the
    rounds grow with the logarithm of the longest path.  Before the first shuffle
    each task drops edges that close a circle among those that it has read, which
    changes no component but leaves a dense one few edges more than nodes and
    tasks need.  Before each round the nodes whose only edge leads to a smaller
    node are set aside with it, if they have a quarter of the edges or more, for
    they can't be a minimum: what is settled isn't carried on, and a round costs
    what is still open.  In the end they get the component of that node,
    those set aside last first.  The minimum of a hub's neighbours is
    pre-aggregated before the shuffle, and the joins that follow have one row
    per node on their other side, so adaptive execution may split a hub's
    edges.  Tables are written to the shared folder after each round.
    Self-loops and nulls are ignored; an empty table gives an empty result.
    """
    u, v = F.col(a), F.col(b)
    given = edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    found, (n,) = _written(_thinned(given).distinct(), "edges", None, F.count(F.lit(1)))
    aside: list[DataFrame] = []
    for _ in range(rounds):
        if not n:
            break
        leaf = (F.col("n") == 1) & (F.col("m") < F.col("u"))
        low = _both(found).groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", "m", leaf.alias("leaf"))
        low, (leaves,) = _written(low, "nearest", 2 * n, F.count_if("leaf"))
        if 4 * leaves >= n:  # fewer aren't worth a join
            aside.append(low.where("leaf").select("u", F.col("m").alias("v")))
        if leaves == n:
            break
        left = found.join(low.where("leaf").select("u"), "u", "left_anti") if 4 * leaves >= n else found
        large = _both(left).where(F.col("v") > F.col("u")).join(low.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        used = found
        found, (n,) = _written(small.distinct(), "edges", 2 * n, F.count(F.lit(1)))
        removed(used)
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    if not aside:
        return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
    done = aside[-1].select(F.col("u").alias("node"), F.col("v").alias("component"))
    for leaves in reversed(aside[:-1]):
        of = done.select(F.col("node").alias("v"), "component")
        done = done.unionByName(saved(leaves.join(of, "v", "left").select(F.col("u").alias("node"), F.coalesce("component", "v").alias("component")), "settled"))
    return done.unionByName(done.groupBy("component").count().select(F.col("component").alias("node"), "component"))


def _thinned(edges: DataFrame) -> DataFrame:
    """A spanning forest of the edges (u, v) of each task, in parts of at most FOREST_EDGES edges."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= FOREST_EDGES:
                held = _forest(held)
                n = sum(b.num_rows for b in held)
                if 2 * n > FOREST_EDGES:  # held on, it would soon be full again
                    yield from held
                    held, n = [], 0
        if n:
            yield from _forest(held)

    kind = dict(edges.dtypes)["u"]
    return map_batches(edges, work, f"u {kind}, v {kind}")


def _forest(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    nodes = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks().dictionary_encode()
    code, n = np.asarray(nodes.indices), len(table)
    kept = minimum_forest(len(nodes.dictionary), code[:n], code[n:], np.zeros(n, np.int64))
    return table.take(pa.array(kept)).combine_chunks().to_batches()


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _written(table: DataFrame, name: str, rows: int | None, *seen: Column) -> tuple[DataFrame, tuple[int, ...]]:
    """The table as written, of at most ``rows`` rows, if that is known, and aggregates observed while it is written."""
    watch = Observation()
    written = saved(table.observe(watch, *(x.alias(f"x{k}") for k, x in enumerate(seen))), name, rows)
    return written, tuple(watch.get[f"x{k}"] for k in range(len(seen)))
