"""Results as text, JSON and CSV, and snapshots of tables with replay of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.operators.graph import GraphResult
from entigraph.streaming import changes


def table_text(rows: DataFrame, most: int = 20) -> str:
    """A table for people, of a few rows."""
    head = rows.limit(most + 1).collect()
    names = rows.columns
    cells = [[("null" if v is None else str(v)) for v in r] for r in head[:most]]
    widths = [max([len(n), *(len(c[k]) for c in cells)]) for k, n in enumerate(names)]
    line = lambda values: "| " + " | ".join(v.ljust(w) for v, w in zip(values, widths)) + " |"
    rule = "+-" + "-+-".join("-" * w for w in widths) + "-+"
    return "\n".join([rule, line(names), rule, *map(line, cells), rule, *(["..."] if len(head) > most else [])])


def json_rows(rows: DataFrame) -> DataFrame:
    """One JSON text per row, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_result(result: GraphResult, folder: str, kind: str = "parquet") -> None:
    """Root, blocks and edges below a folder, as parquet, json or csv (with header)."""
    parts = {"root": result.root, **{f"blocks/{p}": b for p, b in result.blocks.items()}, **{f"edges/{p}": e for p, e in result.edges.items()}}
    for name, rows in parts.items():
        writer = rows.write.mode("overwrite")
        {"parquet": writer.parquet, "json": writer.json, "csv": lambda path: writer.csv(path, header=True)}[kind](f"{folder}/{name}")


def backup(tables: dict[str, DataFrame], folder: str, lsn: int) -> None:
    """A full snapshot; the number in its name says up to where it holds the changes."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/snapshot-{lsn:020d}/{name}")


def backup_changes(log: DataFrame, folder: str, after_lsn: int) -> None:
    log.where(F.col("lsn") > after_lsn).write.mode("append").parquet(f"{folder}/changes")


def restore(spark: SparkSession, folder: str, name: str, lsn: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/snapshot-{lsn:020d}/{name}")


def restore_until(snapshot: DataFrame, log: DataFrame, entity: str, key: str, after_lsn: int, until_lsn: int) -> DataFrame:
    """The snapshot with the changes after it replayed, up to a number; the log carries the snapshot's columns."""
    own = log.where((F.col("entity") == entity) & (F.col("lsn") > after_lsn) & (F.col("lsn") <= until_lsn))
    touched = own.select(F.col("id").alias(key)).distinct()
    state = changes.applied(own).withColumnRenamed("id", key).select(*snapshot.columns)
    return snapshot.join(touched, key, "left_anti").unionByName(state)
