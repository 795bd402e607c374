"""Versioned rows: an append-only history per entity, views of it, and set-based mutations.

A history has the entity's fields, ``version_ts`` and ``deleted``.  Mutations
return the rows to append: a DataFrame append is atomic per job.  The newest
version is taken with an aggregate that combines before the shuffle, so a row
with very many versions isn't sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entigraph.operators.filters import condition
from entigraph.plans import ir

TIME, DELETED = "version_ts", "deleted"


def _newest(history: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    rest = [c for c in history.columns if c not in identity]
    newest = F.max_by(F.struct(*rest), F.struct(TIME, DELETED))
    return history.groupBy(*identity).agg(newest.alias("_v")).select(*[F.col(c) if c in identity else F.col(f"_v.{c}").alias(c) for c in history.columns])


def latest_view(history: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """Newest version of each row, without deleted ones."""
    return _newest(history, identity).where(~F.col(DELETED)).drop(DELETED, TIME)


def as_of(history: DataFrame, identity: tuple[str, ...], at: object) -> DataFrame:
    """The view as it was: a row deleted by then is absent, not resurrected."""
    return latest_view(history.where(F.col(TIME) <= F.lit(at)), identity)


def versions(history: DataFrame, where: Column) -> DataFrame:
    """All versions of the rows that match, oldest first."""
    return history.where(where).orderBy(TIME)


def get(history: DataFrame, identity: tuple[str, ...], keys: list[tuple]) -> DataFrame:
    """Live rows of some identities."""
    spark = history.sparkSession
    wanted = spark.createDataFrame(keys, history.select(*identity).schema)
    return latest_view(history.join(F.broadcast(wanted), list(identity), "left_semi"), identity)


def inserted(rows: DataFrame, at: Column) -> DataFrame:
    """New rows; an identity of null gets a UUID if it is a string."""
    return rows.withColumn(TIME, at).withColumn(DELETED, F.lit(False))


def updated(view: DataFrame, patch: DataFrame, identity: tuple[str, ...], at: Column) -> DataFrame:
    """Versions for the rows that a patch names: its columns replace the row's, and a missing row is none."""
    changed = [c for c in patch.columns if c not in identity]
    renamed = patch.select(*identity, *(F.col(c).alias(f"_{c}") for c in changed))
    joined = view.join(renamed, list(identity))
    return inserted(joined.select(*[F.col(f"_{c}").alias(c) if c in changed else F.col(c) for c in view.columns]), at)


def changed_fields(view: DataFrame, patch: DataFrame, identity: tuple[str, ...]) -> DataFrame:
    """Identity and the names of the fields whose value really differs."""
    names = [c for c in patch.columns if c not in identity]
    renamed = patch.select(*identity, *(F.col(c).alias(f"_{c}") for c in names))
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in names]
    return view.join(renamed, list(identity)).select(*identity, F.array_compact(F.array(*differs)).alias("changed"))


def deleted(view: DataFrame, keys: DataFrame, identity: tuple[str, ...], at: Column) -> DataFrame:
    """Tombstones of the rows that exist."""
    return view.join(keys.select(*identity).distinct(), list(identity), "left_semi").withColumn(TIME, at).withColumn(DELETED, F.lit(True))


def upserted(view: DataFrame, rows: DataFrame, identity: tuple[str, ...], at: Column) -> DataFrame:
    """Versions for all rows given: merged over the existing one, or new."""
    renamed = rows.select(*identity, F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in rows.columns if c not in identity))
    joined = renamed.join(view, list(identity), "left")
    return inserted(joined.select(*[F.col(f"_{c}").alias(c) if c in rows.columns and c not in identity else F.col(c) for c in view.columns]), at)


def updated_where(view: DataFrame, what: ir.Filter | None, values: dict[str, Column], at: Column) -> DataFrame:
    """Versions for all rows that match a filter."""
    rows = view if what is None else view.where(condition(what, view.schema))
    return inserted(rows.withColumns(values), at)


def deleted_where(view: DataFrame, what: ir.Filter, at: Column) -> DataFrame:
    return view.where(condition(what, view.schema)).withColumn(TIME, at).withColumn(DELETED, F.lit(True))


def compacted(history: DataFrame, identity: tuple[str, ...], keep: int, younger_than: object, tombstones_before: object) -> DataFrame:
    """The newest ``keep`` versions and all younger ones; rows whose newest version is an old tombstone go entirely."""
    newest_first = Window.partitionBy(*identity).orderBy(F.col(TIME).desc())
    ranked = history.withColumn("_rank", F.row_number().over(newest_first))
    stay = ranked.where((F.col("_rank") <= keep) | (F.col(TIME) >= F.lit(younger_than)))
    gone = ranked.where((F.col("_rank") == 1) & F.col(DELETED) & (F.col(TIME) < F.lit(tombstones_before))).select(*identity)
    return stay.join(gone, list(identity), "left_anti").drop("_rank")


class Conflict(RuntimeError):
    pass


class Transaction:
    """Staged appends over a history: reads see them, commit checks expected versions and returns the rows to append."""

    def __init__(self, history: DataFrame, identity: tuple[str, ...]) -> None:
        self.history, self.identity = history, identity
        self.staged: list[DataFrame] = []
        self.expected: list[tuple[tuple, object]] = []
        self.open = True

    def view(self) -> DataFrame:
        rows = self.history
        for part in self.staged:
            rows = rows.unionByName(part)
        return latest_view(rows, self.identity)

    def _stage(self, rows: DataFrame) -> None:
        if not self.open:
            raise RuntimeError("the transaction has ended")
        self.staged.append(rows.select(*self.history.columns))

    def insert(self, rows: DataFrame, at: Column) -> None:
        self._stage(inserted(rows, at))

    def update(self, patch: DataFrame, at: Column) -> None:
        self._stage(updated(self.view(), patch, self.identity, at))

    def delete(self, keys: DataFrame, at: Column) -> None:
        self._stage(deleted(self.view(), keys, self.identity, at))

    def expect(self, key: tuple, version: object) -> None:
        """The newest version of a row must be this one at commit."""
        self.expected.append((key, version))

    def commit(self) -> DataFrame:
        for key, version in self.expected:
            own = self.history
            for c, value in zip(self.identity, key, strict=True):
                own = own.where(F.col(c) == F.lit(value))
            if own.agg(F.max(TIME)).first()[0] != version:
                raise Conflict(f"{key} has another version")
        self.open = False
        rows = self.history.limit(0)
        for part in self.staged:
            rows = rows.unionByName(part)
        return rows

    def rollback(self) -> None:
        self.staged.clear()
        self.open = False
