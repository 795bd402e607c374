"""Graph queries: a root set, related sets along paths, and the edges between them, as lazy DataFrames."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entigraph.operators import aggregate, search, security
from entigraph.operators.filters import condition, split_ranking
from entigraph.plans import ir
from entigraph.plans.model import Entity, Relation, Schema
from entigraph.plans.planner import MAX_DEPTH, Plan, PlannedInclude, plan


def ordering(order: tuple[ir.Order, ...], identity: tuple[str, ...]) -> list[Column]:
    """Sort keys with the identity last, so that limits are deterministic; nulls first ascending, last descending."""
    keys = [F.col(o.field).desc_nulls_last() if o.descending else F.col(o.field).asc_nulls_first() for o in order]
    return keys + [F.col(c).asc() for c in identity if c not in {o.field for o in order}]


@dataclass
class GraphResult:
    """``root`` and ``blocks`` hold the asked fields, ``edges`` pairs of identities (from_..., to_...) by path."""

    root: DataFrame
    blocks: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    plan: Plan | None = None
    _more: Callable[[], bool] = lambda: False

    def has_more(self) -> bool:
        """Whether the root's limit left rows out: asks for one row beyond the page."""
        return self._more()


class Engine:
    """Queries over tables of one schema.  ``tables`` maps an entity to its rows; policies and masks are optional."""

    def __init__(self, schema: Schema, tables: dict[str, DataFrame], policies: tuple[security.Policy, ...] = (), strict: bool = False, max_depth: int = MAX_DEPTH) -> None:
        self.schema, self.tables, self.policies = schema, tables, policies
        self.strict, self.max_depth = strict, max_depth

    def query(self, entity: str) -> ir.Query:
        return ir.Query(self, ir.GraphQuery(entity))

    def rows(self, entity: Entity, context: security.Context | None) -> DataFrame:
        """Rows of an entity that the context may see."""
        if context is not None and not context.may("read", entity.name):
            raise PermissionError(f"read of {entity.name} is denied")
        table = self.tables[entity.name]
        if context is None:
            return table
        allowed = security.row_condition(self.policies, entity.name, context, table.schema)
        return table if allowed is None else table.where(allowed)

    def execute(self, query: ir.GraphQuery, context: security.Context | None = None) -> GraphResult:
        planned = plan(self.schema, query, min(self.max_depth, context.budget.depth if context else MAX_DEPTH))
        root, unlimited, offset, limit = self._root(planned, context)
        if context is not None and context.enforce_budget:
            security.check_rows(root, context.budget.entities, "entities")
        frames, blocks, edges, spent = {"": root}, {}, {}, 0
        for step in planned.includes:
            frames[step.path], edges[step.path] = self._include(step, frames[step.parent], planned.entity if not step.parent else self._entity(planned, step.parent), context)
            if context is not None and context.enforce_budget:
                spent += security.check_rows(edges[step.path], context.budget.edges - spent, "edges")
            blocks[step.path] = self._projected(frames[step.path], step.entity, step.include.fields, context)
        more = (lambda: False) if limit is None else lambda: unlimited.offset(offset + limit).limit(1).count() > 0
        return GraphResult(self._projected(root, planned.entity, query.fields, context), blocks, edges, planned, more)

    def _entity(self, planned: Plan, path: str) -> Entity:
        return next(s.entity for s in planned.includes if s.path == path)

    def _root(self, planned: Plan, context: security.Context | None) -> tuple[DataFrame, DataFrame, int, int | None]:
        query, entity = planned.query, planned.entity
        plain, ranking = split_ranking(query.where)
        rows = self.rows(entity, context)
        if plain is not None:
            rows = rows.where(condition(plain, rows.schema, strict=self.strict))
        order = ordering(query.order, entity.identity)
        if ranking is not None:
            rows, score = search.ranked(rows, ranking, entity)
            order = order if query.order else [*score, *order]
        elif not query.order:
            order = ordering(tuple(ir.Order(f, d) for f, d in entity.default_order), entity.identity)
        limit, offset = query.limit, query.offset
        if limit is None and not offset and not query.order and ranking is None:
            return rows, rows, 0, None
        ordered = rows.orderBy(*order)
        page = ordered.offset(offset) if offset else ordered
        return (page if limit is None else page.limit(limit)), ordered, offset, limit

    def _include(self, step: PlannedInclude, parents: DataFrame, parent: Entity, context: security.Context | None) -> tuple[DataFrame, DataFrame]:
        """Child rows, each once, and the edges from parents to them."""
        include, relation, entity = step.include, step.relation, step.entity
        children = self.rows(entity, context)
        if include.where is not None:
            children = children.where(condition(include.where, children.schema, strict=self.strict))
        links = self._links(relation, parents, parent, context)  # parent identity, child key
        keys = [f"_key{k}" for k in range(len(relation.to_fields))]
        same = functools.reduce(lambda a, b: a & b, [F.col(k) == F.col(c) for k, c in zip(keys, relation.to_fields)])
        order = ordering(include.order, entity.identity)
        froms = [f"from_{c}" for c in parent.identity]
        # One-to-many: a parent's children share its key, so ranks are taken once per key and not once per parent.
        group = keys if relation.edge_entity is None else froms
        if include.limit is None and not include.offset:
            paired = links.join(children, same)
            matched = links.select(*keys).distinct().join(children, same) if relation.edge_entity is None else paired
        elif relation.edge_entity is None:
            matched = self._page(links.select(*keys).distinct().join(children, same), group, order, include)
            paired = links.join(matched.drop(*keys), same)
        else:
            paired = matched = self._page(links.join(children, same), group, order, include)
        block = matched.select(*children.columns)
        block = block if relation.edge_entity is None else block.dropDuplicates(list(entity.identity))
        if include.order:
            block = block.orderBy(*order)
        edge = paired.select(*froms, *(F.col(c).alias(f"to_{c}") for c in entity.identity))
        return block, edge

    @staticmethod
    def _page(rows: DataFrame, group: list[str], order: list[Column], include: ir.Include) -> DataFrame:
        """Within each parent the rows after ``offset`` and up to ``limit`` of them."""
        ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
        keep = F.col("_rank") > include.offset
        if include.limit is not None:
            keep &= F.col("_rank") <= include.offset + include.limit
        return ranked.where(keep).drop("_rank")

    def _links(self, relation: Relation, parents: DataFrame, parent: Entity, context: security.Context | None) -> DataFrame:
        own = [F.col(c).alias(f"from_{c}") for c in parent.identity]
        if relation.edge_entity is None:
            return parents.select(*own, *(F.col(c).alias(f"_key{k}") for k, c in enumerate(relation.from_fields)))
        edge = self.rows(self.schema.entity(relation.edge_entity), context)
        left = parents.select(*own, *(F.col(c).alias(f"_from{k}") for k, c in enumerate(relation.from_fields)))
        right = edge.select(*(F.col(c).alias(f"_from{k}") for k, c in enumerate(relation.edge_from)), *(F.col(c).alias(f"_key{k}") for k, c in enumerate(relation.edge_to))).distinct()
        on = [f"_from{k}" for k in range(len(relation.from_fields))]
        return left.join(right, on).drop(*on)

    def _projected(self, rows: DataFrame, entity: Entity, fields: tuple[str, ...], context: security.Context | None) -> DataFrame:
        extra = [c for c in ("_score", "_distance") if c in rows.columns]
        names = [*dict.fromkeys([*entity.identity, *fields])] if fields else [f.name for f in entity.fields if f.name in rows.columns]
        return rows.select(*security.masked(entity, names, context), *extra)

    def aggregate(self, query: ir.AggregateQuery, context: security.Context | None = None) -> DataFrame:
        """Aggregates over the rows and fields that the context may see."""
        entity = self.schema.entity(query.root)
        rows = self.rows(entity, context)
        if context is not None:
            hidden = security.hidden(entity, context)
            used = {a.field for a in query.aggregates} | set(query.group_by)
            if hidden & used:
                raise PermissionError(f"aggregate over hidden fields {sorted(hidden & used)}")
        return aggregate.run(rows, query, self.strict)


def nested(result: GraphResult, schema: Schema, path: str, name: str | None = None) -> DataFrame:
    """Root rows with their related rows at a one-step ``path`` as a sorted array of structs; empty if there are none."""
    if "." in path:
        raise ValueError("nest one step at a time")
    step = next(s for s in result.plan.includes if s.path == path)
    parent, child = result.plan.entity, step.entity
    block, edges = result.blocks[path], result.edges[path]
    to = [F.col(f"to_{c}") == F.col(c) for c in child.identity]
    rows = edges.join(block, functools.reduce(lambda a, b: a & b, to)).drop(*(f"to_{c}" for c in child.identity))
    grouped = rows.groupBy(*(F.col(f"from_{c}").alias(c) for c in parent.identity)).agg(F.sort_array(F.collect_list(F.struct(*block.columns))).alias(name or path))
    return result.root.join(grouped, list(parent.identity), "left").withColumn(name or path, F.coalesce(F.col(name or path), F.array()))


def keyset_page(rows: DataFrame, order: tuple[ir.Order, ...], identity: tuple[str, ...], last: tuple, limit: int) -> DataFrame:
    """The page after the row whose sort keys and identity are ``last``: a lexicographic condition, no offset."""
    keys = [*order, *(ir.Order(c) for c in identity)]
    after, equal = F.lit(False), F.lit(True)
    for key, value in zip(keys, last, strict=True):
        c = F.col(key.field)
        beyond = (c < F.lit(value)) if key.descending else (c > F.lit(value))
        after, equal = after | (equal & beyond), equal & (c == F.lit(value))
    return rows.where(after).orderBy(*ordering(order, identity)).limit(limit)


def with_includes(query: ir.GraphQuery, *paths: str) -> ir.GraphQuery:
    return replace(query, includes=(*query.includes, *(ir.Include(p) for p in paths)))
