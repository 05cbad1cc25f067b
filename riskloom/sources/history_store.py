"""The transaction history as a Parquet table that grows by days.

One folder a day (``day`` = whole days since time 0, -1 without a time), files
sorted by (time, id) with disjoint ranges inside a day.  Adding rows rewrites
the days they fall on and no other; a reader opens the days it needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators import features as FE
from riskloom.session import cut_lineage
from riskloom.sources.io import read_table_or_empty

DAY_SECONDS = 86_400
DAY = "day"


def day_of(time: str = FE.DT):
    return F.coalesce(F.floor(F.col(time) / DAY_SECONDS), F.lit(-1)).cast("long")


def add_rows(rows: DataFrame, path: str) -> list[int]:
    """Merge ``rows`` into the history at ``path``; returns the days that were rewritten.

    A transaction id that is stored on its day already keeps the stored row, so
    the same rows added again change nothing; on another day it is another row.  Of ids repeated within ``rows``
    the earliest stays, ties going to the smallest values; rows without an id
    are refused, as they could not be told from copies.
    """
    spark = rows.sparkSession
    if not rows.where(F.col(FE.TID).isNull()).isEmpty():
        raise ValueError("rows of the history need an id")
    others = sorted((c for c in rows.columns if c != FE.TID), key=lambda c: c != FE.DT)
    fresh = cut_lineage(FE.keep_first(rows, FE.TID, others).withColumn(DAY, day_of()))
    days = sorted(r[DAY] for r in fresh.select(DAY).distinct().collect())          # one number a day
    if not days:
        return []
    stored = read_table_or_empty(spark, path, fresh.schema).where(F.col(DAY).isin(days))
    left = fresh.join(stored.select(FE.TID, DAY), [FE.TID, DAY], "left_anti")
    changed = cut_lineage(stored.select(*fresh.columns).unionByName(left.select(*fresh.columns)))
    order = [DAY, FE.DT, FE.TID]
    (changed.repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path))
    return days


def read_days(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """The history with its ``day`` column, from day ``first`` to day ``last``; other folders are not opened."""
    out = spark.read.parquet(path)
    if first is not None:
        out = out.where(F.col(DAY) >= first)
    if last is not None:
        out = out.where(F.col(DAY) <= last)
    return out.withColumn(DAY, F.col(DAY).cast("long"))


def before(probes: DataFrame, path: str) -> DataFrame:
    """The days that can matter to ``probes``: nothing later than the last of them counts as its history."""
    last = probes.agg(F.max(day_of())).first()[0]
    return read_days(probes.sparkSession, path, last=-1 if last is None else last).drop(DAY)
