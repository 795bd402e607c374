"""Aggregates over one entity: filtered, grouped, with conditions on groups; one pass, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entigraph.operators.filters import condition, family
from entigraph.plans import ir


def column(rows: DataFrame, what: ir.Aggregate) -> Column:
    """Sums and averages are doubles; the sum of nothing is 0, its average null; text adds nothing to a sum."""
    name = what.alias or (f"{what.function}_{what.field}" if what.field else what.function)
    if what.function == "count":
        return (F.count(F.lit(1)) if what.field is None else F.count(what.field)).alias(name)
    if what.field is None:
        raise ValueError(f"{what.function} needs a field")
    if what.field not in rows.columns:
        raise ValueError(f"unknown field {what.field!r}")
    c = F.col(what.field)
    number = c.cast("double") if family(rows.schema[what.field].dataType) == "number" else F.lit(None).cast("double")
    made = {
        "sum": lambda: F.coalesce(F.sum(number), F.lit(0.0)),
        "avg": lambda: F.avg(number),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "count_distinct": lambda: F.count_distinct(c),
    }
    if what.function not in made:
        raise ValueError(f"unknown aggregate {what.function!r}")
    return made[what.function]().alias(name)


def run(rows: DataFrame, query: ir.AggregateQuery, strict: bool = False) -> DataFrame:
    if query.where is not None:
        rows = rows.where(condition(query.where, rows.schema, strict=strict))
    units = dict(query.truncate)
    keys = [F.date_trunc(units[g], F.col(g)).alias(g) if g in units else F.col(g) for g in query.group_by]
    found = rows.groupBy(*keys).agg(*(column(rows, a) for a in query.aggregates))
    return found if query.having is None else found.where(condition(query.having, found.schema))
