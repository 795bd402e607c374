"""Schema migration: differences, safety grades, plans, and backfills as projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entigraph.plans.model import Entity, Field, FieldType, Schema

#: Grades of type changes between scalars; any other change is D.
WIDENING = (("int32", "int64"), ("float32", "float64"), ("int32", "float64"), ("int64", "float64"), ("string", "bytes"))
OPTIONAL_WIDENING = (("int32", "int64"), ("float32", "float64"))
NARROWING = (("int64", "int32"), ("float64", "float32"))
#: Changes that a backfill can cast.
CASTABLE = WIDENING[:4]


@dataclass(frozen=True)
class Change:
    """``what``: e.g. entity_added, field_type; ``where``: entity or entity.field; with both sides of the change."""

    what: str
    where: str
    before: object = None
    after: object = None


def diff(old: Schema, new: Schema) -> list[Change]:
    out = [Change("entity_removed", n, old.entities[n]) for n in old.entities if n not in new.entities]
    for name, entity in new.entities.items():
        out += _entity_diff(old.entities[name], entity) if name in old.entities else [Change("entity_added", name, None, entity)]
    for key in {**old.relations, **new.relations}:
        a, b, where = old.relations.get(key), new.relations.get(key), ".".join(key)
        if a is None or b is None:
            out.append(Change("relation_added" if a is None else "relation_removed", where, a, b))
        elif a != b:
            ends = lambda r: (r.to_entity, r.from_fields, r.to_fields, r.cardinality, r.edge_entity)
            if ends(a) != ends(b):
                out.append(Change("relation_shape", where, a, b))
            if a.on_delete != b.on_delete:
                out.append(Change("relation_on_delete", where, a.on_delete, b.on_delete))
    a, b = ({c.name: c for c in s.constraints} for s in (old, new))
    out += [Change("constraint_removed", n, a[n]) for n in a if b.get(n) != a[n]]
    out += [Change("constraint_added", n, None, b[n]) for n in b if a.get(n) != b[n]]
    return out


def _entity_diff(old: Entity, new: Entity) -> list[Change]:
    out = []
    if old.identity != new.identity:
        out.append(Change("identity", old.name, old.identity, new.identity))
    if old.soft_delete != new.soft_delete:
        out.append(Change("soft_delete", old.name, old.soft_delete, new.soft_delete))
    if old.default_order != new.default_order:
        out.append(Change("default_order", old.name, old.default_order, new.default_order))
    before, after = ({f.name: f for f in e.fields} for e in (old, new))
    out += [Change("field_removed", f"{old.name}.{n}", before[n]) for n in before if n not in after]
    for name, f in after.items():
        where, was = f"{old.name}.{name}", before.get(name)
        if was is None:
            out.append(Change("field_added", where, None, f))
            continue
        for part in ("type", "required", "default", "indexed", "computed"):
            if getattr(was, part) != getattr(f, part):
                out.append(Change(f"field_{part}", where, getattr(was, part), getattr(f, part)))
    return out


def grade_type(a: FieldType, b: FieldType) -> str:
    if a == b:
        return "A"
    pair = (a.scalar, b.scalar)
    if "enum" in a.shape and a.shape == b.shape and a.name == b.name:
        return "A" if set(a.variants) <= set(b.variants) else "D"
    if (a.shape, b.shape) in (("scalar", "optional"), ("optional", "scalar")) and a.scalar == b.scalar:
        return "A" if a.shape == "scalar" else "C"
    if a.shape != b.shape:
        return "D"
    if a.shape == "optional":
        return "B" if pair in OPTIONAL_WIDENING else "D"
    if a.shape in ("scalar", "array"):
        return "B" if pair in WIDENING else "C" if pair in NARROWING else "D"
    return "D"


def grade(change: Change, new: Schema) -> str:
    """A: safe; B: safe with a backfill; C: may fail on data; D: destroys or breaks."""
    what = change.what
    if what in ("entity_added", "relation_added", "constraint_removed", "default_order", "field_default"):
        return "A"
    if what in ("entity_removed", "relation_removed", "field_removed", "identity", "relation_shape"):
        return "D"
    if what in ("constraint_added", "relation_on_delete", "field_computed"):
        return "B"
    if what == "soft_delete":
        return "A" if change.after else "C"
    if what == "field_indexed":
        return "B" if change.after else "A"
    if what == "field_type":
        return grade_type(change.before, change.after)
    if what == "field_added":
        return _required(change.after)
    if what == "field_required":
        entity, _, name = change.where.partition(".")
        return _required(new.entity(entity).field(name)) if change.after else "A"
    raise ValueError(f"unknown change {what!r}")


def _required(f: Field) -> str:
    if not f.required or f.type.nullable:
        return "A"
    return "D" if f.default is None else "B"


def overall(changes: list[Change], new: Schema) -> str:
    return max((grade(c, new) for c in changes), default="A")


@dataclass(frozen=True)
class Step:
    phase: str  # expand, backfill, validate, contract
    action: str
    where: str
    detail: object = None


PHASES = ("expand", "backfill", "validate", "contract")


def plan(changes: list[Change], new: Schema) -> list[Step]:
    """Steps in the order expand, backfill, validate, contract."""
    steps: list[Step] = []
    for c in changes:
        if c.what.endswith("_added") and c.what != "constraint_added":
            steps.append(Step("expand", f"add_{c.what.removesuffix('_added')}", c.where, c.after))
        if c.what in ("field_added", "field_required"):
            entity, _, name = c.where.partition(".")
            f = new.entity(entity).field(name)
            if f.default is not None:
                steps.append(Step("backfill", "default" if c.what == "field_added" else "nulls", c.where, f.default))
            if f.required:
                steps.append(Step("validate", "not_null", c.where))
        if c.what == "field_type" and (c.before.scalar, c.after.scalar) in CASTABLE:
            steps += [Step("expand", "add_field", c.where, c.after), Step("backfill", "cast", c.where, c.after), Step("contract", "drop_old_type", c.where, c.before)]
        if c.what == "field_computed" and c.after is not None:
            steps.append(Step("backfill", "compute", c.where, c.after))
        if c.what == "field_indexed" and c.after:
            steps.append(Step("backfill", "index", c.where))
        if c.what == "constraint_added":
            steps += [Step("validate", "constraint", c.where, c.after), Step("contract", "enforce", c.where, c.after)]
        if c.what.endswith("_removed"):
            steps.append(Step("contract", f"drop_{c.what.removesuffix('_removed')}", c.where, c.before))
    return sorted(steps, key=lambda s: PHASES.index(s.phase))


class Run:
    """Progress of a plan: steps run in order, a failed or stopped run resumes, and done steps roll back in reverse."""

    def __init__(self, steps: list[Step]) -> None:
        self.steps, self.done = steps, 0

    def resume(self, perform) -> None:
        while self.done < len(self.steps):
            perform(self.steps[self.done])
            self.done += 1

    def rollback(self, undo) -> None:
        while self.done:
            undo(self.steps[self.done - 1])
            self.done -= 1

    @property
    def status(self) -> str:
        return "done" if self.done == len(self.steps) else "pending" if not self.done else "running"


# -- backfills: projections, no shuffle --------------------------------------


def backfill_default(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return rows.withColumn(name, value)


def backfill_nulls(rows: DataFrame, name: str, value: Column) -> DataFrame:
    return rows.withColumn(name, F.coalesce(F.col(name), value))


def copy_field(rows: DataFrame, source: str, to: str, kind: str | None = None) -> DataFrame:
    return rows.withColumn(to, F.col(source).cast(kind) if kind else F.col(source))


def compute_field(rows: DataFrame, name: str, expression: str) -> DataFrame:
    return rows.withColumn(name, F.expr(expression))
