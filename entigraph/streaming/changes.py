"""Change log: batches by sequence number, replay, and subscriptions as streams.

A change has lsn, ts, entity, id, op (insert, update, delete) and further
columns for the row's image.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from entigraph.operators.filters import condition
from entigraph.plans import ir


@dataclass(frozen=True)
class Batch:
    rows: DataFrame
    from_lsn: int
    size: int
    _all: DataFrame

    def has_more(self) -> bool:
        return self._all.orderBy("lsn").offset(self.size).limit(1).count() > 0

    def next_lsn(self) -> DataFrame:
        """One row: the number to ask for next, the same one if the batch is empty."""
        return self.rows.agg((F.coalesce(F.max("lsn") + 1, F.lit(self.from_lsn))).cast("long").alias("next_lsn"))


def batch(log: DataFrame, from_lsn: int, size: int, entities: tuple[str, ...] = ()) -> Batch:
    """Up to ``size`` changes from a number on (inclusive), of some entities if any are named."""
    rows = log.where(F.col("lsn") >= from_lsn)
    if entities:
        rows = rows.where(F.col("entity").isin(*entities))
    return Batch(rows.orderBy("lsn").limit(size), from_lsn, size, rows)


def truncated(log: DataFrame, before_lsn: int) -> DataFrame:
    return log.where(F.col("lsn") >= before_lsn)


def appended(log: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """New changes with numbers after the log's last; the batch is one mutation's, numbered in one ordered pass."""
    from pyspark.sql import Window

    last = log.agg(F.coalesce(F.max("lsn"), F.lit(0))).first()[0]
    return changes.withColumn("lsn", (F.row_number().over(Window.orderBy(*order)) + last).cast("long"))


def applied(log: DataFrame, key: str = "id") -> DataFrame:
    """State after replay: the newest change of each row, unless it is a delete; combined before the shuffle."""
    rest = [c for c in log.columns if c not in ("entity", key)]
    newest = log.groupBy("entity", key).agg(F.max_by(F.struct(*rest), "lsn").alias("_v"))
    return newest.where("_v.op <> 'delete'").select("entity", key, *(F.col(f"_v.{c}").alias(c) for c in rest))


def status(log: DataFrame, replica_lsn: int) -> DataFrame:
    """One row: the log's last number and how far a replica lags."""
    last = F.coalesce(F.max("lsn"), F.lit(0))
    return log.agg(last.alias("current_lsn"), (last - replica_lsn).alias("lag_entries"))


def subscription(spark: SparkSession, path: str, schema: T.StructType, entity: str | None = None, where: ir.Filter | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """A stream of the changes in a folder of files, filtered and projected."""
    rows = spark.readStream.schema(schema).parquet(path)
    if entity is not None:
        rows = rows.where(F.col("entity") == entity)
    if where is not None:
        rows = rows.where(condition(where, rows.schema))
    return rows.select(*fields) if fields else rows


def deliver(stream: DataFrame, checkpoint: str, to: Callable[[DataFrame, int], None] | str) -> StreamingQuery:
    """Deliver what is there and stop; a later call with the same checkpoint goes on where this one ended.

    ``to``: a folder for Parquet files (exactly once), or a function of each micro-batch.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if isinstance(to, str):
        return writer.format("parquet").option("path", to).start()
    return writer.foreachBatch(to).start()
