"""Query model: filters, graph queries, aggregate queries, and a builder for them."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any


class Filter:
    def __and__(self, other: "Filter") -> "Filter":
        return And((self, other))

    def __or__(self, other: "Filter") -> "Filter":
        return Or((self, other))

    def __invert__(self) -> "Filter":
        return Not(self)


@dataclass(frozen=True)
class Compare(Filter):
    field: str
    op: str  # eq, ne, lt, le, gt, ge
    value: Any


@dataclass(frozen=True)
class In(Filter):
    field: str
    values: tuple
    negated: bool = False


@dataclass(frozen=True)
class Null(Filter):
    field: str
    negated: bool = False


@dataclass(frozen=True)
class Like(Filter):
    field: str
    pattern: str
    negated: bool = False
    ignore_case: bool = False


@dataclass(frozen=True)
class And(Filter):
    parts: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Or(Filter):
    parts: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Not(Filter):
    part: Filter


@dataclass(frozen=True)
class GeoRadius(Filter):
    field: str
    lat: float
    lon: float
    km: float


@dataclass(frozen=True)
class GeoBox(Filter):
    field: str
    min_lat: float
    min_lon: float
    max_lat: float
    max_lon: float


@dataclass(frozen=True)
class GeoPolygon(Filter):
    field: str
    vertices: tuple[tuple[float, float], ...]


class Ranking(Filter):
    """A search that ranks the rows that the other filters leave."""


@dataclass(frozen=True)
class GeoNear(Ranking):
    field: str
    lat: float
    lon: float
    k: int


@dataclass(frozen=True)
class VectorNear(Ranking):
    field: str
    vector: tuple[float, ...]
    k: int
    max_distance: float | None = None
    metric: str = "cosine"


@dataclass(frozen=True)
class TextMatch(Ranking):
    field: str
    query: str
    min_score: float = 0.0
    config: str = "default"


@dataclass(frozen=True)
class TextPhrase(Ranking):
    field: str
    phrase: str
    config: str = "default"


@dataclass(frozen=True)
class TextBoolean(Ranking):
    field: str
    must: tuple[str, ...] = ()
    should: tuple[str, ...] = ()
    must_not: tuple[str, ...] = ()
    config: str = "default"


def eq(field: str, value: Any) -> Filter:
    return Compare(field, "eq", value)


def ne(field: str, value: Any) -> Filter:
    return Compare(field, "ne", value)


def lt(field: str, value: Any) -> Filter:
    return Compare(field, "lt", value)


def le(field: str, value: Any) -> Filter:
    return Compare(field, "le", value)


def gt(field: str, value: Any) -> Filter:
    return Compare(field, "gt", value)


def ge(field: str, value: Any) -> Filter:
    return Compare(field, "ge", value)


def between(field: str, low: Any, high: Any) -> Filter:
    return And((ge(field, low), le(field, high)))


def _plain(text: str) -> str:
    return "".join("\\" + c if c in "\\%_" else c for c in text)


def contains(field: str, text: str, ignore_case: bool = False) -> Filter:
    return Like(field, f"%{_plain(text)}%", ignore_case=ignore_case)


def starts_with(field: str, text: str, ignore_case: bool = False) -> Filter:
    return Like(field, f"{_plain(text)}%", ignore_case=ignore_case)


def ends_with(field: str, text: str, ignore_case: bool = False) -> Filter:
    return Like(field, f"%{_plain(text)}", ignore_case=ignore_case)


@dataclass(frozen=True)
class Order:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Include:
    """Related rows at a dotted path; ``limit`` and ``offset`` hold per parent."""

    path: str
    fields: tuple[str, ...] = ()
    where: Filter | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class GraphQuery:
    root: str
    fields: tuple[str, ...] = ()
    where: Filter | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    offset: int = 0
    includes: tuple[Include, ...] = ()


@dataclass(frozen=True)
class Aggregate:
    function: str  # count, sum, avg, min, max, count_distinct
    field: str | None = None
    alias: str = ""


@dataclass(frozen=True)
class AggregateQuery:
    root: str
    aggregates: tuple[Aggregate, ...]
    where: Filter | None = None
    group_by: tuple[str, ...] = ()
    truncate: tuple[tuple[str, str], ...] = ()  # field -> unit: groups of a date
    having: Filter | None = None  # over the aliases


class Query:
    """Fluent builder; every step returns a new builder, and repeated conditions all hold."""

    def __init__(self, engine: Any, query: GraphQuery) -> None:
        self._engine, self.query = engine, query

    def _with(self, **changes: Any) -> "Query":
        return Query(self._engine, replace(self.query, **changes))

    def where(self, condition: Filter) -> "Query":
        before = self.query.where
        return self._with(where=condition if before is None else And((before, condition)))

    filter = where
    expr = where

    def eq(self, field: str, value: Any) -> "Query":
        return self.where(eq(field, value))

    def ne(self, field: str, value: Any) -> "Query":
        return self.where(ne(field, value))

    def gt(self, field: str, value: Any) -> "Query":
        return self.where(gt(field, value))

    def gte(self, field: str, value: Any) -> "Query":
        return self.where(ge(field, value))

    def lt(self, field: str, value: Any) -> "Query":
        return self.where(lt(field, value))

    def lte(self, field: str, value: Any) -> "Query":
        return self.where(le(field, value))

    def null(self, field: str) -> "Query":
        return self.where(Null(field))

    def not_null(self, field: str) -> "Query":
        return self.where(Null(field, True))

    def like(self, field: str, pattern: str) -> "Query":
        return self.where(Like(field, pattern))

    def ilike(self, field: str, pattern: str) -> "Query":
        return self.where(Like(field, pattern, ignore_case=True))

    def is_in(self, field: str, values: list) -> "Query":
        return self.where(In(field, tuple(values)))

    def not_in(self, field: str, values: list) -> "Query":
        return self.where(In(field, tuple(values), True))

    def between(self, field: str, low: Any, high: Any) -> "Query":
        return self.where(between(field, low, high))

    def contains(self, field: str, text: str) -> "Query":
        return self.where(contains(field, text))

    def starts_with(self, field: str, text: str) -> "Query":
        return self.where(starts_with(field, text))

    def ends_with(self, field: str, text: str) -> "Query":
        return self.where(ends_with(field, text))

    def select(self, *fields: str) -> "Query":
        return self._with(fields=fields)

    def order_by(self, field: str) -> "Query":
        return self._with(order=(*self.query.order, Order(field)))

    def order_by_desc(self, field: str) -> "Query":
        return self._with(order=(*self.query.order, Order(field, True)))

    def limit(self, n: int) -> "Query":
        return self._with(limit=n)

    def offset(self, n: int) -> "Query":
        return self._with(offset=n)

    def include(self, path: str, **options: Any) -> "Query":
        return self._with(includes=(*self.query.includes, Include(path, **options)))

    def include_filtered(self, path: str, condition: Filter) -> "Query":
        return self.include(path, where=condition)

    def execute(self, context: Any = None):
        return self._engine.execute(self.query, context)

    def first(self, context: Any = None):
        return self._engine.execute(replace(self.query, limit=1), context).root

    def count(self, context: Any = None) -> int:
        return self._engine.execute(self.query, context).root.count()
