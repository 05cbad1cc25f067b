"""Small shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import ensure_checkpoint_dir

#: Rows per Arrow batch sent to a Python worker; texts may be long, so batches stay small.
BATCH_ROWS = 512
#: Text handled at once inside a worker: small enough for the numpy arrays over it to stay in the processor cache.
CHUNK_BYTES = 128_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by Spark's own reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no other column can clash with a derived one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Bound the Arrow batches of this session, then hand the frame back."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus`` (null for a null id)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of one piece stay near ``limit`` bytes (one long row may exceed it)."""
    for batch in batches:
        at, size = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            n = n or 0
            if i > at and size + n > limit:
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if batch.num_rows > at:
            yield batch.slice(at)


def stored(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared checkpoint folder and read it back (cuts lineage, survives lost executors)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(keys: DataFrame, limit: int) -> DataFrame:
    """``keys`` as the side of a join: sent to all executors if it has at most ``limit`` rows, else shuffled."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys
