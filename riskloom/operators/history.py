"""Point-in-time history lookups for a table of probes.

The reference answers one transaction at a time with a full scan per
question.  Here all probes are answered in one plan: probes are unioned with
the history table and every "same card / device / pair, strictly earlier"
question becomes a range-frame window (``features.behaviour`` with
``semantics="pit"``), so no non-equi join is ever formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.operators import features as FE
from riskloom.operators.keyed import SkewConfig
from riskloom.session import cut_lineage

TID, DT, AMT, CARD, DEV = FE.TID, FE.DT, FE.AMT, FE.CARD, FE.DEV
# Fixed value: device texts that mean "no device" for cold start only (trap 7).
NO_DEVICE_SENTINELS = ("UNKNOWN-DEVICE",)


def probe_frame(probes: DataFrame, history: DataFrame) -> DataFrame:
    """Union of history rows (_h=1) and probes (_o=1) over the five lookup columns."""
    cols = [TID, DT, AMT, CARD, DEV]
    h = history.select(*cols).withColumn("_h", F.lit(1)).withColumn("_o", F.lit(0))
    extra = [c for c in probes.columns if c not in cols]
    p = probes.select(*cols, *extra).withColumn("_h", F.lit(0)).withColumn("_o", F.lit(1))
    return h.unionByName(p, allowMissingColumns=True)


#: Distinct probe cards / devices sent to every executor at most; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def wanted_keys(keys: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> tuple[DataFrame, bool]:
    """(distinct keys without nulls, whether they are few): sent to every executor if counted to be few, else shuffled."""
    k = cut_lineage(keys.dropna().distinct())
    few = k.count() <= broadcast_keys
    return (F.broadcast(k) if few else k), few


def relevant(probes: DataFrame, history: DataFrame, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """History rows that can matter to a probe: same card or same device.

    The other rows never enter the window shuffle, so a small batch of probes
    reads the history but does not sort it.
    """
    cards, few_cards = wanted_keys(probes.select(F.col(CARD).alias(f"_k{CARD}")), broadcast_keys)
    devices, few_devices = wanted_keys(probes.select(F.col(DEV).alias(f"_k{DEV}")), broadcast_keys)
    of_card, of_device = F.col(CARD) == F.col(f"_k{CARD}"), F.col(DEV) == F.col(f"_k{DEV}")
    if not (few_cards and few_devices):
        # two halves that never overlap; a semi join drops null keys before its shuffle
        other = history.join(cards, of_card, "left_anti").join(devices, of_device, "left_semi")
        return history.join(cards, of_card, "left_semi").unionByName(other)
    card_too = F.col(f"_k{CARD}").isNotNull()
    return (history.join(cards, of_card, "left").join(devices, of_device, "left")
            .where(card_too | F.col(f"_k{DEV}").isNotNull()).drop(f"_k{CARD}", f"_k{DEV}"))


def lookup(probes: DataFrame, history: DataFrame, skew: SkewConfig | None = None) -> DataFrame:
    """The 13 behaviour features of each probe against strictly earlier history."""
    frame = probe_frame(probes, relevant(probes, history))
    out = FE.behaviour(frame, "pit", skew)
    return out.where(F.col("_o") == 1).drop("_h", "_o")


def features_21(probes: DataFrame, history: DataFrame, skew: SkewConfig | None = None,
                raw_columns: Sequence[str] | None = None) -> DataFrame:
    """W14 in full: the basic features of the probe itself and its point-in-time behaviour features."""
    if "has_identity" not in probes.columns:
        probes = probes.withColumn("has_identity", F.col(DEV).isNotNull().cast("int"))
    return lookup(FE.basic_features(probes, raw_columns), history, skew)


def cold_start(features: DataFrame, sentinels: Sequence[str] = NO_DEVICE_SENTINELS) -> DataFrame:
    """Six cold-start flags from point-in-time counts.

    Device history needs a usable device that is not a sentinel; pair history
    needs both card and device history.  A probe with no card or time gets
    the all-new answer.
    """
    basic_ok = F.col(CARD).isNotNull() & F.col(DT).isNotNull()
    dev = F.col(DEV)
    dev_ok = dev.isNotNull() & (F.trim(dev) != "") & ~F.upper(dev).isin([s.upper() for s in sentinels])
    card_hist = basic_ok & (F.col("card_transaction_count") > 0)
    dev_hist = basic_ok & dev_ok & (F.col("device_profile_count") > 0)
    pair_hist = card_hist & dev_hist & (F.col("card_device_transaction_count") > 0)
    return features.select(
        "*", (~card_hist).alias("is_new_card"), (~dev_hist).alias("is_new_device"),
        (~pair_hist).alias("is_new_card_device_pair"), card_hist.alias("card_history_available"),
        dev_hist.alias("device_history_available"), pair_hist.alias("card_device_history_available"))


def card_profile(probes: DataFrame, history: DataFrame, skew: SkewConfig | None = None) -> DataFrame:
    """A1: count, mean, max, min of strictly earlier amounts of the probe's card (0 when none).

    Same skew handling as the behaviour features: hot cards are split into
    time buckets and each bucket receives one offset row carrying the count,
    sum, max and min of all earlier buckets (prefix sums / prefix max / min
    over the key-level bucket table), so no card lands whole in one task.
    """
    from riskloom.operators import keyed as K
    from riskloom.operators.keyed import OFFSET, ROW, SENTINEL

    cfg = skew or SkewConfig()
    frame = probe_frame(probes, relevant(probes, history)).select(TID, DT, AMT, CARD, "_h", "_o")
    hot = K.hot_days(frame.select(CARD, DT), CARD, DT, cfg)
    s = K.add_salt(frame, CARD, DT, TID, hot, cfg).withColumn("_kind", F.lit(ROW))
    hist_amt = F.when(F.col("_h") == 1, F.col(AMT))
    if hot is not None:
        per = s.where(F.col("_salt") >= 1).groupBy(CARD, "_salt").agg(
            F.sum("_h").alias("_c"), F.count(hist_amt).alias("_nn"),
            F.sum(hist_amt.cast(FE.MONEY)).alias("_s"), F.max(hist_amt).alias("_mx"), F.min(hist_amt).alias("_mn"))
        bw = Window.partitionBy(CARD).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        offs = per.select(CARD, "_salt", F.sum("_c").over(bw).alias("_oc"), F.sum("_nn").over(bw).alias("_onn"),
                          F.sum("_s").over(bw).alias("_os"), F.max("_mx").over(bw).alias("_omx"),
                          F.min("_mn").over(bw).alias("_omn"), F.lit(OFFSET).alias("_kind"),
                          F.lit(SENTINEL).alias(DT), F.lit(SENTINEL).alias(TID))
        s = s.unionByName(offs, allowMissingColumns=True)
    else:
        for c, t in (("_oc", "long"), ("_onn", "long"), ("_os", FE.MONEY), ("_omx", "double"), ("_omn", "double")):
            s = s.withColumn(c, F.lit(None).cast(t))
    row, off = F.col("_kind") == ROW, F.col("_kind") == OFFSET
    w = Window.partitionBy(CARD, "_salt").orderBy(DT).rangeBetween(Window.unboundedPreceding, -1)
    u = s.select(
        "*",
        F.sum(F.when(row, F.col("_h")).when(off, F.col("_oc"))).over(w).alias("cnt"),
        F.sum(F.when(row, hist_amt.isNotNull().cast("long")).when(off, F.col("_onn"))).over(w).alias("nn"),
        F.sum(F.when(row, hist_amt.cast(FE.MONEY)).when(off, F.col("_os"))).over(w).alias("sm"),
        F.max(F.when(row, hist_amt).when(off, F.col("_omx"))).over(w).alias("mx"),
        F.min(F.when(row, hist_amt).when(off, F.col("_omn"))).over(w).alias("mn"))
    valid = F.col(CARD).isNotNull()
    return u.where(row & (F.col("_o") == 1)).select(
        TID,
        F.when(valid, F.coalesce(F.col("cnt"), F.lit(0))).otherwise(F.lit(0)).cast("long").alias("card_history_count"),
        F.when(valid & (F.col("nn") > 0), F.col("sm").cast("double") / F.col("nn")).otherwise(F.lit(0.0))
        .alias("card_history_mean"),
        F.when(valid, F.coalesce(F.col("mx"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("card_history_max"),
        F.when(valid, F.coalesce(F.col("mn"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("card_history_min"))


def device_view(txns: DataFrame, identity: DataFrame) -> DataFrame:
    """Inner join device rows with their transactions (keep-first identity)."""
    ident = FE.keep_first(identity.select(TID, DEV), TID, [DEV]).where(F.col(DEV).isNotNull())
    return ident.join(txns, on=TID, how="inner")


def overlay_payload(payloads: DataFrame, base: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Match each payload to a base row on (card1, DT) — first by id — and
    let payload fields win where present.

    ``synthetic`` says that a base row was found (the record is then built from
    it); ``_fields`` counts the fields of the record, the flag included.  Card
    and time match as numbers, so "13926.0" finds 13926.  ``payloads`` has an id
    column ``request_id`` and a ``payload`` map<string,string>.
    """
    flag = (~F.map_contains_key("payload", F.lit("synthetic"))).cast("int")
    p = payloads.select("request_id", "payload", (F.size("payload") + flag).alias("_fields"),
                        F.expr("try_cast(payload['card1'] as double)").alias("_card"),
                        F.expr("try_cast(payload['TransactionDT'] as double)").alias("_dt"))
    # only base rows that a payload asks for are grouped; the one with the smallest id per (card1, DT) by an aggregate
    asked, _ = wanted_keys(p.select("_card", "_dt"))
    keyed = base.select(F.col(CARD).cast("double").alias("_card"), F.col(DT).cast("double").alias("_dt"),
                        F.struct(*base.columns).alias("_row"))
    b1 = (keyed.join(asked, ["_card", "_dt"], "left_semi").groupBy("_card", "_dt")
          .agg(F.min_by("_row", F.col(f"_row.{TID}")).alias("_b")))
    j = p.join(b1, on=["_card", "_dt"], how="left")
    cols = [F.col("request_id"), F.col("_b").isNotNull().alias("synthetic"), F.col("_fields")]
    for f in fields:
        base_v = F.col(f"_b.{f}").cast("string") if f in base.columns else F.lit(None).cast("string")
        cols.append(F.when(F.map_contains_key("payload", F.lit(f)), F.col("payload")[f]).otherwise(base_v).alias(f))
    return j.select(*cols)
