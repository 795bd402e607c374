"""Durable intermediate tables.

Iterative and multi-pass operators cut their lineage by writing Parquet below
``spark.checkpoint.dir``, the folder that driver and executors share.  Parquet
instead of ``checkpoint()`` because later passes read only the columns they
need, and because a lost executor takes none of it along.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"
_PATH = "_entigraph_path"
#: Files of a table whose rows are bounded: so many rows each, and so many files at least.
ROWS_PER_FILE, LEAST_FILES = 100_000, 16


def root(spark: SparkSession) -> str:
    """A folder of our own in the shared one; in the warehouse, which is shared too, where the session names none."""
    folder = spark.conf.get(SETTING, None) or spark.conf.get(WAREHOUSE)
    return folder.rstrip("/") + "/entigraph"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` once and return the written table: same rows, no lineage.

    With ``rows``, a bound of its rows, the table gets no more files than that
    needs, however many shuffle partitions the session asks for.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(LEAST_FILES, -(-rows // ROWS_PER_FILE)))
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    setattr(table, _PATH, path)
    return table


def removed(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        if path := getattr(table, _PATH, None):
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package even if the driver runs in another folder."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in known:
        env["PYTHONPATH"] = os.pathsep.join([here, *filter(None, known)])
