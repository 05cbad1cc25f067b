"""Maintained history profiles (J9-J13, W14, X1): arrivals are answered from per-key profiles, not from the history.

A store holds, for every batch (epoch) of history rows, four small tables of
what the batch adds:

* ``card_days``    (card1, day): rows, exact sum and count of amounts;
* ``device_days``  (DeviceInfo, day): rows;
* ``pair_days``    (DeviceInfo, card1, day): rows, and the first second seen;
* ``seconds``      (card1, DeviceInfo, second): the same, one folder a day.

A point-in-time feature of a row at second t is then the sum over the profile
days of its key before t's day, and over the seconds of t's day and the day
before.  So a batch reads the profile rows of its own cards and devices and
two days of seconds for each of its days, however long the history is.

An epoch writes its own folders and reads those of earlier epochs only, so a
retried epoch overwrites what it wrote and gives the same answer.  ``compact``
adds epochs up into one.  No key's history lies in one task: windows cover one
day of one key (its distinct seconds), and days are joined as sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators import features as FE
from riskloom.operators import keyed as K
from riskloom.operators import stats as S
from riskloom.session import cut_lineage

TID, DT, AMT, CARD, DEV = FE.TID, FE.DT, FE.AMT, FE.CARD, FE.DEV
TABLES = {
    "card_days": f"{CARD} long, day long, n long, s {FE.MONEY}, a long",
    "device_days": f"{DEV} string, day long, n long",
    "pair_days": f"{DEV} string, {CARD} long, day long, n long, first long",
    "seconds": f"{CARD} long, {DEV} string, {DT} long, n long, s {FE.MONEY}, a long, day long",
}
#: Epoch of the history a store starts from.
BASE = -1
#: Distinct cards, devices or days of a batch sent to every executor at most; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000
#: Rows of ``pair_days`` of a batch's devices up to which one window ranks the cards of a device.
DIRECT_PAIRS = 200_000
#: Days of a batch up to which the folders to read are named one by one.
NAMED_DAYS = 400


class ProfileStore:
    """The four tables under ``path``, one folder for each epoch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, rows: DataFrame, epoch: int = BASE) -> None:
        """Write what ``rows`` add as ``epoch``, in the place of what that epoch wrote before."""
        money = F.coalesce(FE._money(F.col(AMT)), FE._zero_money())
        sums = [F.count(F.lit(1)).alias("n"), F.sum(money).cast(FE.MONEY).alias("s"), F.count(AMT).alias("a")]
        per = cut_lineage(rows.where(F.col(DT).isNotNull()).groupBy(CARD, DEV, DT).agg(*sums).withColumn("day", K.day_of(DT)))
        usable = FE.device_valid("pit")
        again = [F.sum("n").alias("n"), F.sum("s").cast(FE.MONEY).alias("s"), F.sum("a").alias("a")]
        self._write("card_days", per.where(F.col(CARD).isNotNull()).groupBy(CARD, "day").agg(*again), epoch)
        self._write("device_days", per.where(usable).groupBy(DEV, "day").agg(again[0]), epoch)
        self._write("pair_days", per.where(usable & F.col(CARD).isNotNull()).groupBy(DEV, CARD, "day")
                    .agg(again[0], F.min(DT).alias("first")), epoch)
        self._write("seconds", per, epoch)

    def _write(self, table: str, df: DataFrame, epoch: int) -> None:
        keys = {"card_days": [CARD], "device_days": [DEV], "pair_days": [DEV, CARD], "seconds": [CARD, DT]}[table]
        w = df.sortWithinPartitions(*keys).write.mode("overwrite")
        if table == "seconds":
            w = df.repartition("day").sortWithinPartitions("day", *keys).write.mode("overwrite").partitionBy("day")
        w.parquet(f"{self.path}/{table}/epoch={epoch}")

    def read(self, table: str, before: int) -> DataFrame:
        """What all epochs before ``before`` have written (empty where there are none)."""
        schema = TABLES[table] + ", epoch long"
        try:
            found = self.spark.read.schema(schema).parquet(f"{self.path}/{table}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema).drop("epoch")
        return found.where(F.col("epoch") < before).drop("epoch")

    def compact(self, upto: int, into: ProfileStore) -> None:
        """Add all epochs up to ``upto`` up into the base of another store."""
        again = [F.sum("n").alias("n"), F.sum("s").cast(FE.MONEY).alias("s"), F.sum("a").alias("a")]
        for table, keys, sums in (("card_days", [CARD, "day"], again), ("device_days", [DEV, "day"], again[:1]),
                                  ("pair_days", [DEV, CARD, "day"], [again[0], F.min("first").alias("first")]),
                                  ("seconds", [CARD, DEV, DT, "day"], again)):
            into._write(table, self.read(table, upto + 1).groupBy(*keys).agg(*sums), BASE)


def _keys(rows: DataFrame, column: str) -> DataFrame:
    """The distinct keys of a batch (``k``), sent to all executors if they are few."""
    found = cut_lineage(rows.where(F.col(column).isNotNull()).select(F.col(column).alias("k")).distinct())
    return F.broadcast(found) if found.count() <= BROADCAST_KEYS else found


def _own(table: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    return table.join(keys, F.col(column) == F.col("k"), "left_semi")


def _earlier_days(asked: DataFrame, days: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """(by..., day, sums as x0) for the asked (by..., day): sums over the days before, by running totals of days."""
    per = days.groupBy(*by, "day").agg(*[F.sum(c).alias(c) for c in sums])
    every = per.unionByName(asked.select(*by, "day").distinct().select(*by, "day", F.lit(True).alias("_asked")),
                            allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("day").rangeBetween(FE.UNB, -1)
    return (every.select(*by, "day", "_asked", *[F.sum(c).over(w).alias(f"{c}0") for c in sums])
            .where("_asked").drop("_asked"))


def _same_day(asked: DataFrame, seconds: DataFrame, by: Sequence[str], sums: Sequence[str], trailing: bool) -> DataFrame:
    """(by..., DT, sums as x1, v1, v24) for the asked (by..., DT): earlier seconds of the day, and trailing windows."""
    per = seconds.groupBy(*by, "day", DT).agg(*[F.sum(c).alias(c) for c in sums])
    home = F.explode(F.array(F.col("day"), F.col("day") + 1)) if trailing else F.col("day")
    per = per.withColumn("home", home)
    want = asked.select(*by, DT).distinct().select(*by, DT, K.day_of(DT).alias("home"), F.lit(True).alias("_asked"))
    w = Window.partitionBy(*by, "home").orderBy(DT)
    own = F.col("home") == F.col("day")
    cols = [F.sum(F.when(own, F.col(c))).over(w.rangeBetween(FE.UNB, -1)).alias(f"{c}1") for c in sums]
    if trailing:
        cols += [F.sum("n").over(w.rangeBetween(-k, -1)).alias(v) for v, k in (("v1", FE.HOUR), ("v24", FE.DAY))]
    return per.unionByName(want, allowMissingColumns=True).select(*by, DT, "_asked", *cols).where("_asked").drop("_asked")


def answer(rows: DataFrame, store: ProfileStore, epoch: int) -> DataFrame:
    """The 13 behaviour features of every row against the epochs before ``epoch`` (point in time: earlier seconds)."""
    spark, zero = store.spark, lambda c: F.coalesce(c, F.lit(0))
    rows = cut_lineage(rows.withColumn("day", K.day_of(DT)))
    cards, devices = _keys(rows, CARD), _keys(rows.where(FE.device_valid("pit")), DEV)
    found = rows.where("day IS NOT NULL").select(F.explode(F.array(F.col("day"), F.col("day") - 1)).alias("k")).distinct()
    named = [r[0] for r in found.limit(NAMED_DAYS + 1).collect()]
    seconds = store.read("seconds", epoch)
    # few days are named, so that only their folders are listed and read; many are joined
    seconds = seconds.where(F.col("day").isin(named)) if len(named) <= NAMED_DAYS else _own(seconds, F.broadcast(found), "day")

    by_card = _own(seconds, cards, CARD)
    money, pair = ("n", "s", "a"), [DEV, CARD]
    usable = FE.device_valid("pit")
    of_card, of_device = rows.where(F.col(CARD).isNotNull()), rows.where(usable)
    of_pair = of_device.where(F.col(CARD).isNotNull())
    by_device = _own(seconds.where(usable), devices, DEV)
    pairs = cut_lineage(_own(store.read("pair_days", epoch), devices, DEV))
    first = pairs.groupBy(*pair).agg(F.min("first").alias(DT)).withColumn("day", K.day_of(DT)).withColumn("c", F.lit(1))

    # distinct history cards of the device with a smaller number, asked cards weighing nothing: a window while the
    # pairs of all devices together are few, else a prefix over buckets of card numbers
    ranked = first.select(*pair, F.lit(1).alias("w")).unionByName(of_pair.select(*pair).distinct().withColumn("w", F.lit(0)))
    if pairs.count() <= DIRECT_PAIRS:
        below = Window.partitionBy(DEV).orderBy(CARD).rangeBetween(FE.UNB, -1)
        smaller = ranked.select(*pair, F.sum("w").over(below).alias("_smaller")).distinct()
    else:
        smaller = S.value_histogram(ranked, CARD, [DEV], weight="w", out=CARD).select(*pair, F.col("n_below").alias("_smaller"))

    parts = [
        (_earlier_days(of_card, _own(store.read("card_days", epoch), cards, CARD), [CARD], money), [CARD, "day"], ""),
        (_same_day(of_card, by_card, [CARD], money, True), [CARD, DT], ""),
        (_earlier_days(of_device, _own(store.read("device_days", epoch), devices, DEV), [DEV], ["n"]), [DEV, "day"], "d"),
        (_same_day(of_device, by_device, [DEV], ["n"], False), [DEV, DT], "d"),
        (_earlier_days(of_device, first, [DEV], ["c"]), [DEV, "day"], ""),
        (_same_day(of_device, first, [DEV], ["c"], False), [DEV, DT], ""),
        (_earlier_days(of_pair, pairs, pair, ["n"]), [*pair, "day"], "p"),
        (_same_day(of_pair, by_device.where(F.col(CARD).isNotNull()), pair, ["n"], False), [*pair, DT], "p"),
        (smaller, pair, ""),
    ]
    out = rows
    for part, keys, prefix in parts:
        named_part = part.select(*keys, *[F.col(c).alias(f"_{prefix}{c}" if not c.startswith("_") else c)
                                          for c in part.columns if c not in keys])
        out = out.join(named_part, keys, "left")
    total = lambda p, c: zero(F.col(f"_{p}{c}0")) + zero(F.col(f"_{p}{c}1"))
    out = (out.withColumn("_cnt", total("", "n")).withColumn("_sm", total("", "s").cast(FE.MONEY))
           .withColumn("_nn", total("", "a")).withColumn("_v1", zero(F.col("_v1"))).withColumn("_v24", zero(F.col("_v24")))
           .withColumn("w7", total("d", "n")).withColumn("w8", total("", "c")).withColumn("w10", total("p", "n"))
           .withColumn("w12", zero(F.col("_smaller"))))
    out = FE._finish_card(out.drop("day"), "pit")
    return FE.finish_device(out, "pit", F.col("w7"), F.col("w8"), F.col("w10"), F.col("w12")).drop("w7", "w8", "w10", "w12")
