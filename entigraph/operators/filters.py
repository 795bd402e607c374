"""Filters as columns.

Conditions are two-valued: a comparison with null is false, its negation true.
Where a condition is not under a negation, unknown and false drop a row alike,
so the plain comparison is used and reaches the Parquet scan; under a negation
unknown is made false first.
"""

from __future__ import annotations

import datetime
import functools
import math
import operator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from entigraph.functions import geo
from entigraph.plans import ir

_COMPARE = {"lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(kind, T.BinaryType):
        return "bytes"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "other"


def literal_family(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (bytes, bytearray)):
        return "bytes"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return "time"
    return "other"


def _kind(schema: T.StructType, name: str) -> T.DataType:
    if name not in schema.fieldNames():
        raise ValueError(f"unknown field {name!r}")
    return schema[name].dataType


def _known(c: Column, negated: bool) -> Column:
    return F.coalesce(c, F.lit(False)) if negated else c


def _not_nan(c: Column, kind: T.DataType, test: Column) -> Column:
    return test & ~F.isnan(c) if isinstance(kind, (T.FloatType, T.DoubleType)) else test


def _equal(name: str, value: Any, schema: T.StructType, negated: bool) -> Column:
    kind, c = _kind(schema, name), F.col(name)
    if value is None:
        return c.isNull()
    if isinstance(value, float) and math.isnan(value) or literal_family(value) != family(kind) or family(kind) == "other":
        return F.lit(False)
    return _known(_not_nan(c, kind, c == F.lit(value)), negated)


def like_pattern(pattern: str) -> str | None:
    """The pattern with backslashes only before %, _ and backslash; null if it can't match (it ends in an escape)."""
    out, chars = [], iter(pattern)
    for c in chars:
        if c != "\\":
            out.append(c)
            continue
        escaped = next(chars, None)
        if escaped is None:
            return None
        out.append("\\" + escaped if escaped in "%_\\" else escaped)
    return "".join(out)


def condition(what: ir.Filter, schema: T.StructType, negated: bool = False, strict: bool = False) -> Column:
    """Column of a filter over rows of ``schema``; ``strict`` refuses and/or inside and/or, and negation."""
    if isinstance(what, ir.Compare):
        kind, c, value = _kind(schema, what.field), F.col(what.field), what.value
        if what.op == "eq":
            return _equal(what.field, value, schema, negated)
        if what.op == "ne":
            return ~_equal(what.field, value, schema, True)
        if what.op not in _COMPARE:
            raise ValueError(f"unknown comparison {what.op!r}")
        comparable = literal_family(value) == family(kind) and family(kind) not in ("bool", "other")
        if not comparable or isinstance(value, float) and math.isnan(value):
            return F.lit(False)
        return _known(_not_nan(c, kind, _COMPARE[what.op](c, F.lit(value))), negated)
    if isinstance(what, ir.In):
        kind, c = _kind(schema, what.field), F.col(what.field)
        values = [v for v in what.values if v is not None and literal_family(v) == family(kind) and not (isinstance(v, float) and math.isnan(v))]
        found = _known(_not_nan(c, kind, c.isin(values)), negated or what.negated) if values and family(kind) != "other" else F.lit(False)
        if None in what.values:
            found = F.coalesce(found, F.lit(False)) | c.isNull()
        return ~found if what.negated else found
    if isinstance(what, ir.Null):
        _kind(schema, what.field)
        return F.col(what.field).isNotNull() if what.negated else F.col(what.field).isNull()
    if isinstance(what, ir.Like):
        kind, c, pattern = _kind(schema, what.field), F.col(what.field), like_pattern(what.pattern)
        if family(kind) != "string" or pattern is None:
            found = F.lit(False)
        else:
            found = _known(c.ilike(pattern) if what.ignore_case else c.like(pattern), negated or what.negated)
        return ~found if what.negated else found
    if isinstance(what, (ir.And, ir.Or)):
        if strict and any(isinstance(p, (ir.And, ir.Or)) for p in what.parts):
            raise ValueError("nested and/or")
        parts = [condition(p, schema, negated, strict) for p in what.parts]
        join, empty = (operator.and_, True) if isinstance(what, ir.And) else (operator.or_, False)
        return functools.reduce(join, parts) if parts else F.lit(empty)
    if isinstance(what, ir.Not):
        if strict:
            raise ValueError("negation")
        return ~condition(what.part, schema, True, strict)
    if isinstance(what, ir.GeoRadius):
        return _known(geo.within_radius(F.col(what.field), what.lat, what.lon, what.km), negated)
    if isinstance(what, ir.GeoBox):
        return _known(geo.within_box(F.col(what.field), what.min_lat, what.min_lon, what.max_lat, what.max_lon), negated)
    if isinstance(what, ir.GeoPolygon):
        return _known(geo.within_polygon(F.col(what.field), what.vertices), negated)
    raise ValueError(f"{type(what).__name__} ranks rows: use it as the root's filter, alone or within a conjunction")


def split_ranking(what: ir.Filter | None) -> tuple[ir.Filter | None, ir.Ranking | None]:
    """The plain conditions, and the one ranking that stands alone or in a conjunction with them."""
    if isinstance(what, ir.Ranking):
        return None, what
    if isinstance(what, ir.And):
        plain, ranking = [], None
        for part in what.parts:
            rest, own = split_ranking(part)
            if own is not None and ranking is not None:
                raise ValueError("two rankings in one query")
            ranking = own or ranking
            if rest is not None:
                plain.append(rest)
        return (ir.And(tuple(plain)) if plain else None), ranking
    return what, None
