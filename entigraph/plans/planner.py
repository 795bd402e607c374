"""Name checks and resolution of include paths, before any DataFrame is built."""

from __future__ import annotations

from dataclasses import dataclass

from entigraph.plans import ir
from entigraph.plans.model import Entity, Relation, Schema

#: Deepest include path of a query.
MAX_DEPTH = 5


@dataclass(frozen=True)
class PlannedInclude:
    path: str
    parent: str  # path of the parent; empty: the root
    relation: Relation
    entity: Entity
    include: ir.Include


@dataclass(frozen=True)
class Plan:
    entity: Entity
    query: ir.GraphQuery
    includes: tuple[PlannedInclude, ...]


def fields_of(what: ir.Filter | None) -> set[str]:
    if what is None:
        return set()
    if isinstance(what, (ir.And, ir.Or)):
        return set().union(*(fields_of(p) for p in what.parts)) if what.parts else set()
    if isinstance(what, ir.Not):
        return fields_of(what.part)
    return {what.field}


def _check(entity: Entity, fields: tuple[str, ...], where: ir.Filter | None, order: tuple[ir.Order, ...]) -> None:
    known = {f.name for f in entity.fields}
    for name in [*fields, *sorted(fields_of(where)), *(o.field for o in order)]:
        if name not in known:
            raise ValueError(f"unknown field {name!r} of {entity.name}")


def plan(schema: Schema, query: ir.GraphQuery, max_depth: int = MAX_DEPTH) -> Plan:
    """Resolve every path; a path asked for twice is taken once, parents come before children, missing ones are added."""
    root = schema.entity(query.root)
    _check(root, query.fields, query.where, query.order)
    _limits(query.limit, query.offset)
    asked: dict[str, ir.Include] = {}
    for include in query.includes:
        if include.path in asked and asked[include.path] != include:
            raise ValueError(f"path {include.path!r} is included twice with different options")
        asked[include.path] = include
    every = dict(asked)
    for path in asked:
        steps = path.split(".")
        if len(steps) > max_depth:
            raise ValueError(f"path {path!r} is deeper than {max_depth}")
        for k in range(1, len(steps)):
            every.setdefault(".".join(steps[:k]), ir.Include(".".join(steps[:k])))
    planned: dict[str, PlannedInclude] = {}
    for path in sorted(every, key=lambda p: (p.count("."), p)):
        parent, _, name = path.rpartition(".")
        relation = schema.relation(planned[parent].entity.name if parent else root.name, name)
        entity, include = schema.entity(relation.to_entity), every[path]
        _check(entity, include.fields, include.where, include.order)
        _limits(include.limit, include.offset)
        planned[path] = PlannedInclude(path, parent, relation, entity, include)
    return Plan(root, query, tuple(planned.values()))


def _limits(limit: int | None, offset: int) -> None:
    if offset < 0 or limit is not None and limit < 0:
        raise ValueError("limit and offset can't be negative")
