"""Skew-safe keyed windows.

A running count "per card, in time order" is a window partitioned by the
card.  If one card (or device) holds a third of all rows, that window is one
task.  Here a key is *hot* when it has more than ``min_hot_rows`` rows,
whatever the size of the table.  A hot key is cut by day, and each of its days
into equal stretches of about ``target_rows`` rows by that day's own count, so
rows that crowd into one day spread as well; rows of one second stay together.
Each (key, stretch) is a window partition of its own (``_salt`` >= 1, rising
with time).  What it cannot see comes in as offset rows (time = ``SENTINEL``,
sorted first) with the totals of all earlier stretches, unioned into the same
shuffle.

Other keys keep ``_salt = 0``.  Rows with a null key have constant features
and are scattered over ``null_spread`` salts, so they never form a large group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.session import cut_lineage

SENTINEL = -(2 ** 62)          # time/id of offset rows: before every real row
DAY = 86_400
FIRST_DAY, STRETCHES = 10 ** 6, 10 ** 5     # make a rising positive number of (day, stretch)

ROW, OFFSET, PAIR_OFFSET = 0, 1, 2


@dataclass(frozen=True)
class SkewConfig:
    min_hot_rows: int = 500_000     # a key with fewer rows is never split
    target_rows: int = 250_000      # aim for this many rows per (key, stretch)
    task_rows: int = 200_000        # aim for this many rows in a task that sorts them
    null_spread: int = 1 << 20      # null keys scatter over this many salts
    broadcast_days: int = 200_000   # larger (hot key, day) tables are joined by shuffle


def day_of(order_col: str) -> Column:
    return F.floor(F.col(order_col) / DAY).cast("long")


def hot_days(df: DataFrame, key: str, order_col: str, cfg: SkewConfig, valid: Column | None = None) -> DataFrame | None:
    """(key, _day, _width): the days of the hot keys and how many seconds a stretch of that day has; None if no key is hot."""
    ok = valid if valid is not None else F.col(key).isNotNull()
    days = df.where(ok).groupBy(key, day_of(order_col).alias("_day")).agg(F.count(F.lit(1)).alias("_cnt"))
    days = days.withColumn("_all", F.sum("_cnt").over(Window.partitionBy(key))).where(F.col("_all") > cfg.min_hot_rows)
    width = F.greatest(F.lit(1), F.floor(F.lit(float(DAY * cfg.target_rows)) / F.col("_cnt"))).cast("long")
    hot = cut_lineage(days.select(key, "_day", width.alias("_width")))
    return None if hot.isEmpty() else hot


def spread(df: DataFrame, rows: int, cfg: SkewConfig, *keys: str) -> DataFrame:
    """``df`` (about ``rows`` rows) dealt by ``keys`` to as many tasks as keep each near ``task_rows``; tables of one
    task's size are left to the planner.

    The number is fixed: a task sorts its rows several times over, which the size of the shuffled bytes does not tell.
    """
    tasks = -(-rows // cfg.task_rows)
    if tasks <= 1:
        return df.repartition(*keys)
    return df.repartition(max(tasks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def few(table: DataFrame, limit: int) -> DataFrame:
    """The side of a join, sent to all executors only if it has at most ``limit`` rows."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def null_salt(spread_col: str, cfg: SkewConfig) -> Column:
    return F.lit(-1) - F.pmod(F.xxhash64(spread_col), F.lit(cfg.null_spread))


def add_salt(df: DataFrame, key: str, order_col: str, spread_col: str, hot: DataFrame | None, cfg: SkewConfig,
             valid: Column | None = None) -> DataFrame:
    """Attach ``_salt``."""
    ok = valid if valid is not None else F.col(key).isNotNull()
    if hot is None:
        return df.withColumn("_salt", F.when(~ok, null_salt(spread_col, cfg)).otherwise(F.lit(0)).cast("long"))
    j = df.withColumn("_day", day_of(order_col)).join(few(hot, cfg.broadcast_days), on=[key, "_day"], how="left")
    stretch = F.floor(F.pmod(F.col(order_col), F.lit(DAY)) / F.col("_width"))
    salt = (F.when(~ok, null_salt(spread_col, cfg)).when(F.col("_width").isNull(), F.lit(0))
            .otherwise((F.col("_day") + FIRST_DAY) * STRETCHES + stretch + 1))
    return j.withColumn("_salt", salt.cast("long")).drop("_day", "_width")
