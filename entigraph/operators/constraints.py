"""Constraints as queries for their violations, and the rows that deletes reach."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entigraph.operators.filters import condition
from entigraph.plans import ir
from entigraph.plans.model import Relation, Schema
from entigraph.plans.workspace import saved


def unique_violations(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Values that several rows have; nulls count as equal."""
    return rows.groupBy(*fields).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def foreign_key_violations(rows: DataFrame, fields: tuple[str, ...], target: DataFrame, target_fields: tuple[str, ...]) -> DataFrame:
    """Rows that refer to nothing; a null reference is allowed."""
    present = functools.reduce(operator.and_, [F.col(c).isNotNull() for c in fields])
    keys = target.select(*(F.col(t).alias(f) for f, t in zip(fields, target_fields, strict=True))).distinct()
    return rows.where(present).join(keys, list(fields), "left_anti")


_CHECK = re.compile(r"\s+|(?P<number>-?\d+(?:\.\d+)?)|(?P<string>'(?:[^']|'')*'|\"[^\"]*\")|(?P<word>[A-Za-z_]\w*)|(?P<sign><=|>=|!=|<>|[=<>(),])")
_SIGNS = {"=": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def parse_check(text: str) -> ir.Filter:
    """A check expression as a filter: and, or, not, is [not] null, [not] in, comparisons with literals, parentheses."""
    tokens, at = [], 0
    while at < len(text):
        m = _CHECK.match(text, at)
        if m is None:
            raise ValueError(f"unexpected {text[at]!r} in check {text!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    place = 0

    def peek() -> str:
        return tokens[place][1].upper() if place < len(tokens) else ""

    def take() -> tuple[str, str]:
        nonlocal place
        if place >= len(tokens):
            raise ValueError(f"check {text!r} ends too early")
        place += 1
        return tokens[place - 1]

    def accept(word: str) -> bool:
        nonlocal place
        found = peek() == word
        place += found
        return found

    def literal() -> object:
        kind, value = take()
        if kind == "number":
            return float(value) if "." in value else int(value)
        if kind == "string":
            return value[1:-1].replace("''", "'") if value[0] == "'" else value[1:-1]
        if value.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[value.upper()]
        raise ValueError(f"expected a literal, not {value!r}, in check {text!r}")

    def either() -> ir.Filter:
        parts = [both()]
        while accept("OR"):
            parts.append(both())
        return parts[0] if len(parts) == 1 else ir.Or(tuple(parts))

    def both() -> ir.Filter:
        parts = [single()]
        while accept("AND"):
            parts.append(single())
        return parts[0] if len(parts) == 1 else ir.And(tuple(parts))

    def single() -> ir.Filter:
        if accept("NOT"):
            return ir.Not(single())
        if accept("("):
            inner = either()
            if not accept(")"):
                raise ValueError(f"missing ) in check {text!r}")
            return inner
        kind, name = take()
        if kind != "word":
            raise ValueError(f"expected a field, not {name!r}, in check {text!r}")
        if accept("IS"):
            negated = accept("NOT")
            if not accept("NULL"):
                raise ValueError(f"expected NULL in check {text!r}")
            return ir.Null(name, negated)
        negated = accept("NOT")
        if accept("IN"):
            if not accept("("):
                raise ValueError(f"expected ( in check {text!r}")
            values = [literal()]
            while accept(","):
                values.append(literal())
            if not accept(")"):
                raise ValueError(f"missing ) in check {text!r}")
            return ir.In(name, tuple(values), negated)
        _, sign = take()
        if negated or sign not in _SIGNS:
            raise ValueError(f"unknown operator {sign!r} in check {text!r}")
        value = literal()
        if value is None:  # no comparison with null holds
            return ir.Or()
        return ir.And((ir.Null(name, True), ir.Compare(name, "ne", value))) if _SIGNS[sign] == "ne" else ir.Compare(name, _SIGNS[sign], value)

    if not tokens:
        return ir.And()
    made = either()
    if place < len(tokens):
        raise ValueError(f"unexpected {tokens[place][1]!r} in check {text!r}")
    return made


def check_column(text: str, schema: T.StructType) -> Column:
    return condition(parse_check(text), schema)


def check_violations(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(condition(ir.Not(parse_check(text)), rows.schema))


def violations(schema: Schema, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Violating rows or values of every constraint."""
    out = {}
    for c in schema.constraints:
        rows = tables[c.entity]
        if c.kind == "unique":
            out[c.name] = unique_violations(rows, c.fields)
        elif c.kind == "foreign_key":
            out[c.name] = foreign_key_violations(rows, c.fields, tables[c.target], c.target_fields)
        else:
            out[c.name] = check_violations(rows, c.expression)
    return out


def referring(parents: DataFrame, relation: Relation, children: DataFrame) -> DataFrame:
    """Children that refer to any of the parents."""
    keys = parents.select(*(F.col(p).alias(c) for p, c in zip(relation.from_fields, relation.to_fields, strict=True))).distinct()
    return children.join(keys, list(relation.to_fields), "left_semi")


class Restricted(RuntimeError):
    pass


def cascade(schema: Schema, tables: dict[str, DataFrame], entity: str, doomed: DataFrame, depth: int = 20) -> dict[str, DataFrame]:
    """Rows that go with ``doomed`` rows of ``entity`` over relations that cascade, by entity (identities).

    Waves of semi-joins: each finds the children of the last wave that aren't
    doomed yet, so cycles end.  Each wave is written, as the next reads it twice.
    """
    found = {entity: doomed.select(*schema.entity(entity).identity).distinct()}
    wave = {entity: doomed}
    for _ in range(depth):
        new: dict[str, DataFrame] = {}
        for (source, _), relation in schema.relations.items():
            if source in wave and relation.on_delete == "cascade" and relation.edge_entity is None:
                target = schema.entity(relation.to_entity)
                children = referring(wave[source], relation, tables[relation.to_entity])
                if relation.to_entity in found:
                    children = children.join(found[relation.to_entity], list(target.identity), "left_anti")
                new[relation.to_entity] = children if relation.to_entity not in new else new[relation.to_entity].unionByName(children).dropDuplicates(list(target.identity))
        wave = {name: rows for name, rows in ((n, saved(r, "cascade")) for n, r in new.items()) if not rows.isEmpty()}
        if not wave:
            return found
        for name, rows in wave.items():
            keys = rows.select(*schema.entity(name).identity)
            found[name] = keys if name not in found else found[name].unionByName(keys)
    raise RuntimeError(f"the cascade is deeper than {depth}")


def nulled(parents: DataFrame, relation: Relation, children: DataFrame) -> DataFrame:
    """All children, with the reference set to null where it is to one of the parents."""
    keys = parents.select(*(F.col(p).alias(c) for p, c in zip(relation.from_fields, relation.to_fields, strict=True)), F.lit(True).alias("_gone")).distinct()
    joined = children.join(keys, list(relation.to_fields), "left")
    return joined.select(*[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c in relation.to_fields else F.col(c) for c in children.columns])


def restrict(parents: DataFrame, relation: Relation, children: DataFrame) -> None:
    if not referring(parents, relation, children).isEmpty():
        raise Restricted(f"rows of {relation.to_entity} refer to the rows to delete")
