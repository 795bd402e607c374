"""What the corpus operators share: Arrow mapping, text chunks, salted look-ups."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entigraph.plans.workspace import worker_path

#: Rows and bytes that an operator's kernel gets at once; a single larger row is a batch of its own.
ROWS_PER_BATCH, BYTES_PER_BATCH = 256, 16 << 20
#: Code points that a vectorised kernel takes at once; a single longer text is a chunk of its own.
CHUNK_CHARS = 1 << 20
#: Rows of a look-up table that are broadcast; a longer one is joined by shuffle with salted keys.
BROADCAST_ROWS = 500_000
#: Copies of each row of a shuffled look-up table, so that one hot key is spread over as many tasks.
SALTS = 16


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` in batches small enough for whole texts, however Spark's own batches are set."""
    worker_path(df.sparkSession)
    rows, size = ROWS_PER_BATCH, BYTES_PER_BATCH
    return df.mapInArrow(lambda batches: work(small_batches(batches, rows, size)), schema)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and ``size`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
        waiting = [batch.slice(a, rows) for a in range(0, batch.num_rows, rows)][::-1]
        while waiting:
            part = waiting.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                waiting += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def free_name(columns: Sequence[str], wanted: str) -> str:
    """A column name that isn't among ``columns``."""
    taken = {c.lower() for c in columns}
    return next(name for k in itertools.count() if (name := f"_{wanted}{k or ''}").lower() not in taken)


def text_chunks(texts: Sequence[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive texts with at most ``limit`` code points, or one text."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, k
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def looked_up(rows: DataFrame, table: DataFrame, key: str, spread: Column, how: str = "left") -> DataFrame:
    """Join ``rows`` with a table that is unique by ``key``.

    The table is counted: up to BROADCAST_ROWS rows it is broadcast, beyond that
    both sides are shuffled with a salt (``spread`` decides a row's salt), so a
    key that holds a third of all rows is still dealt over SALTS tasks.  Rows
    whose key is null match nothing; with ``how="left"`` they stay.
    """
    if table.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(table), key, how)
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [key, "_salt"], how).drop("_salt")
