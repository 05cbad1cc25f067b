"""Leakage-safe behaviour features (W1-W16), two semantics.

``semantics="batch"`` (training form): "before me" means earlier in
(TransactionDT, TransactionID) row order, so rows of the same second count
in id order.  ``semantics="pit"`` (point-in-time form): only strictly earlier
seconds count, as for a newly arriving transaction.

Plan shape: one shuffle by (card1, salt) for the card family and one by
(DeviceInfo, salt) for the device family.  Cards with very many rows take
their totals from one row per card and second instead; devices with very many
rows are cut into stretches whose offsets are unioned into the same shuffle as
marker rows (see ``keyed``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions import columns as C
from riskloom.operators import keyed as K
from riskloom.operators.keyed import OFFSET, PAIR_OFFSET, ROW, SENTINEL, SkewConfig

TID, DT, AMT, CARD, DEV = "TransactionID", "TransactionDT", "TransactionAmt", "card1", "DeviceInfo"
HOUR, DAY = 3600, 86400
UNB = Window.unboundedPreceding
# Money is summed as an exact decimal, so sums do not depend on shuffle order.
MONEY = "decimal(38,18)"
def _zero_money() -> Column:
    return F.lit(0).cast(MONEY)


def _money(c: Column) -> Column:
    return c.cast(MONEY)

CARD_FEATURES = ["card_transaction_count", "card_avg_amount", "amount_vs_card_avg", "new_card",
                 "card_txn_count_1h", "card_txn_count_24h"]
DEVICE_FEATURES = ["has_device_info", "device_profile_count", "device_profile_unique_cards",
                   "new_device_profile", "card_device_transaction_count", "card_device_seen_before",
                   "device_unique_cards_historical"]
BASIC_FEATURES = ["TransactionAmt_log", "transaction_hour", "transaction_day", "has_identity",
                  "missing_card_info", "missing_address", "missing_value_count"]


def _check(semantics: str) -> None:
    if semantics not in ("batch", "pit"):
        raise ValueError(f"semantics must be 'batch' or 'pit', got {semantics!r}")


# ---------------------------------------------------------------------------
# J2 / J1 / J4 and P1-P6
# ---------------------------------------------------------------------------
def keep_first(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per ``key``: the smallest by ``order`` (nulls last).

    An aggregate (``min_by``) rather than a window: partial aggregation keeps a
    key with many duplicates from landing whole in one task.
    """
    others = [c for c in df.columns if c != key]
    rank = F.struct(*[x for o in order for x in (F.col(o).isNull(), F.col(o))])
    return (df.groupBy(key)
            .agg(F.min_by(F.struct(*others), rank).alias("_first"))
            .select(key, *[F.col(f"_first.{c}").alias(c) for c in others]))


def attach_identity(txns: DataFrame, identity: DataFrame, order: Sequence[str] = (DEV,)) -> DataFrame:
    """J1 + J2 + J4: left join de-duplicated identity; ``has_identity`` flag."""
    ident = keep_first(identity.select(TID, DEV), TID, order).withColumn("_matched", F.lit(1))
    out = txns.join(ident, on=TID, how="left")
    return out.withColumn("has_identity", F.coalesce(F.col("_matched"), F.lit(0)).cast("int")).drop("_matched")


def basic_features(df: DataFrame, raw_columns: Sequence[str] | None = None) -> DataFrame:
    """P1-P6.  ``raw_columns`` defaults to every column present (batch form)."""
    out = (df.withColumn("TransactionAmt_log", C.amount_log(AMT))
           .withColumn("transaction_hour", C.hour_of_day(DT))
           .withColumn("transaction_day", C.day_index(DT))
           .withColumn("missing_card_info", C.any_null([c for c in C.CARD_COLUMNS if c in df.columns]))
           .withColumn("missing_address", C.any_null([c for c in C.ADDRESS_COLUMNS if c in df.columns])))
    cols = list(raw_columns) if raw_columns is not None else list(out.columns)
    return out.withColumn("missing_value_count", C.null_count([c for c in cols if c in out.columns]))


# ---------------------------------------------------------------------------
# Card family: W1-W5
# ---------------------------------------------------------------------------
def _card_family(frame: DataFrame, semantics: str, cfg: SkewConfig, n_rows: int, card_src: DataFrame | None = None) -> DataFrame:
    hot = K.hot_days((card_src if card_src is not None else frame).select(CARD, DT), CARD, DT, cfg)
    if hot is None:
        salted = K.spread(K.add_salt(frame, CARD, DT, TID, None, cfg), n_rows, cfg, CARD, "_salt")
        return _finish_card(_card_windows(salted, semantics), semantics)
    cards = K.few(hot.select(CARD).distinct(), cfg.broadcast_days)
    rest = K.spread(K.add_salt(frame.join(cards, CARD, "left_anti"), CARD, DT, TID, None, cfg), n_rows, cfg, CARD, "_salt")
    crowded = frame.join(cards, CARD, "left_semi")
    return _finish_card(_card_windows(rest, semantics).drop("_salt").unionByName(
        _card_seconds(crowded, semantics, cfg, n_rows)), semantics)


def _zero_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def _card_windows(u: DataFrame, semantics: str) -> DataFrame:
    """Running totals of a card: windows over (card, salt).  Adds _cnt, _sm, _nn, _v1, _v24."""
    part = Window.partitionBy(CARD, "_salt")
    hist_amt = F.when(F.col("_h") == 1, F.col(AMT))
    if semantics == "batch":
        rows_w = part.orderBy(DT, TID).rowsBetween(UNB, -1)
        seen = _zero_if_null(F.count(F.lit(1)).over(rows_w))
        old = lambda w: _zero_if_null(F.count(F.lit(1)).over(part.orderBy(DT).rangeBetween(UNB, -(w + 1))))
        total = F.coalesce(F.sum(F.coalesce(_money(F.col(AMT)), _zero_money())).over(rows_w), _zero_money())
        return (u.withColumn("_cnt", seen).withColumn("_sm", total).withColumn("_nn", seen)
                .withColumn("_v1", seen - old(HOUR)).withColumn("_v24", seen - old(DAY)))
    pit_w = part.orderBy(DT).rangeBetween(UNB, -1)
    recent = lambda w: _zero_if_null(F.sum("_h").over(part.orderBy(DT).rangeBetween(-w, -1)))
    return (u.withColumn("_cnt", _zero_if_null(F.sum("_h").over(pit_w)))
            .withColumn("_sm", F.coalesce(F.sum(F.coalesce(_money(hist_amt), _zero_money())).over(pit_w), _zero_money()))
            .withColumn("_nn", _zero_if_null(F.count(hist_amt).over(pit_w)))
            .withColumn("_v1", recent(HOUR)).withColumn("_v24", recent(DAY)))


def _card_seconds(rows: DataFrame, semantics: str, cfg: SkewConfig, n_rows: int) -> DataFrame:
    """The same totals for cards with very many rows, from one row per card and second.

    Totals of earlier days are added up over (card, day), those of earlier
    seconds inside a day, and trailing windows reach into a copy of the day
    before.  So no window holds more than two days of seconds; rows meet only
    those of their own second (batch order inside it).
    """
    batch = semantics == "batch"
    hist_amt = F.when(F.col("_h") == 1, F.col(AMT))
    amount = F.coalesce(_money(F.col(AMT) if batch else hist_amt), _zero_money())
    n = F.lit(1) if batch else F.col("_h")
    per = rows.groupBy(CARD, DT).agg(F.sum(n).alias("_n"), F.sum(amount).alias("_s"),
                                     (F.count(F.lit(1)) if batch else F.count(hist_amt)).alias("_a"))
    per = per.withColumn("_day", K.day_of(DT))
    names = ("_n", "_s", "_a")
    days = per.groupBy(CARD, "_day").agg(*[F.sum(c).alias(c) for c in names])
    earlier_days = Window.partitionBy(CARD).orderBy("_day").rowsBetween(UNB, -1)
    days = days.select(CARD, "_day", *[F.sum(c).over(earlier_days).alias(f"{c}0") for c in names])
    twice = per.withColumn("_home", F.explode(F.array(F.col("_day"), F.col("_day") + 1)))
    twice = K.spread(twice, 2 * n_rows, cfg, CARD, "_home")
    own = F.col("_home") == F.col("_day")
    w = Window.partitionBy(CARD, "_home").orderBy(DT)
    before = lambda c: F.sum(F.when(own, F.col(c))).over(w.rowsBetween(UNB, -1))
    recent = lambda k: _zero_if_null(F.sum("_n").over(w.rangeBetween(-k, -1)))
    seconds = twice.select(CARD, DT, "_day", own.alias("_own"), *[before(c).alias(f"{c}1") for c in names],
                           recent(HOUR).alias("_r1"), recent(DAY).alias("_r24")).where("_own")
    seconds = seconds.join(days, [CARD, "_day"]).select(
        CARD, DT, "_r1", "_r24", *[(F.coalesce(f"{c}0", _zero_money() if c == "_s" else F.lit(0))
                                   + F.coalesce(f"{c}1", _zero_money() if c == "_s" else F.lit(0))).alias(f"{c}b") for c in names])
    out = K.spread(rows, n_rows, cfg, CARD, DT).join(seconds, [CARD, DT])
    same, money = F.lit(0), _zero_money()
    if batch:
        inside = Window.partitionBy(CARD, DT).orderBy(TID).rowsBetween(UNB, -1)
        same = F.count(F.lit(1)).over(inside)
        money = F.coalesce(F.sum(F.coalesce(_money(F.col(AMT)), _zero_money())).over(inside), _zero_money())
    return (out.withColumn("_cnt", F.col("_nb") + same).withColumn("_sm", (F.col("_sb") + money).cast(MONEY))
            .withColumn("_nn", F.col("_ab") + same).withColumn("_v1", F.col("_r1") + same)
            .withColumn("_v24", F.col("_r24") + same).drop("_nb", "_sb", "_ab", "_r1", "_r24"))


def _finish_card(u: DataFrame, semantics: str) -> DataFrame:
    """W1-W5 from the running totals."""
    valid, z = F.col(CARD).isNotNull(), F.lit(0)
    if semantics == "batch":
        avg = F.when(valid & F.col(AMT).isNotNull() & (F.col("_cnt") > 0), F.col("_sm").cast("double") / F.col("_nn"))
        u = (u.withColumn("card_transaction_count", F.when(valid, F.col("_cnt")))
             .withColumn("card_avg_amount", avg)
             .withColumn("amount_vs_card_avg", F.try_divide(F.col(AMT), F.col("card_avg_amount")))
             .withColumn("new_card", F.coalesce((F.col("card_transaction_count") == 0).cast("int"), F.lit(0))))
    else:
        avg = F.when(valid & (F.col("_nn") > 0), F.col("_sm").cast("double") / F.col("_nn")).otherwise(F.lit(0.0))
        u = (u.withColumn("card_transaction_count", F.when(valid, F.col("_cnt")).otherwise(z).cast("long"))
             .withColumn("card_avg_amount", avg)
             .withColumn("amount_vs_card_avg",
                         F.when(F.col("card_avg_amount") > 0,
                                F.coalesce(F.col(AMT), F.lit(0.0)) / F.col("card_avg_amount")).otherwise(F.lit(0.0)))
             .withColumn("new_card", (F.col("card_transaction_count") == 0).cast("int")))
    u = (u.withColumn("card_txn_count_1h", F.when(valid, F.col("_v1")).otherwise(z).cast("long"))
         .withColumn("card_txn_count_24h", F.when(valid, F.col("_v24")).otherwise(z).cast("long")))
    return u.drop(*[c for c in u.columns if c.startswith("_") and c not in ("_h", "_o")])


# ---------------------------------------------------------------------------
# Device family: W6-W12
# ---------------------------------------------------------------------------
def device_valid(semantics: str) -> Column:
    d = F.col(DEV)
    return d.isNotNull() if semantics == "batch" else (d.isNotNull() & (F.trim(d) != ""))


def _device_family(frame: DataFrame, semantics: str, cfg: SkewConfig, n_rows: int, base: DataFrame | None = None) -> DataFrame:
    """``frame`` carries the rows (with card features); ``base`` is the same rows
    before the card windows — side tables are computed from it so that they do
    not re-run the card-family shuffle."""
    valid = device_valid(semantics)
    pair_ok = valid & F.col(CARD).isNotNull()
    side_src = (base if base is not None else frame).select(TID, DT, CARD, DEV, "_h")
    hot = K.hot_days(side_src, DEV, DT, cfg, valid)
    s = K.add_salt(frame, DEV, DT, TID, hot, cfg, valid).withColumn("_kind", F.lit(ROW))
    if hot is None:
        return _device_windows(K.spread(s, n_rows, cfg, DEV, "_salt"), semantics, valid, pair_ok, ranked_in_partition=True)
    # Hot devices: side tables read one narrow, checkpointed copy of (id, time, card, device).
    from riskloom.session import cut_lineage
    side = cut_lineage(K.add_salt(side_src, DEV, DT, TID, hot, cfg, valid))

    # Pair table (one row per device, card and bucket) — key-level, not row-level.
    P = side.where(pair_ok).groupBy(DEV, CARD, "_salt").agg(
        F.count(F.lit(1)).alias("_pc"), F.sum("_h").alias("_ph"))
    Q = P.groupBy(DEV, CARD).agg((F.max("_ph") > 0).cast("int").alias("_hp"))
    # history cards below each card of the device: a bucketed prefix over card numbers,
    # so a device type with very many cards is spread over many tasks
    from riskloom.operators import stats as S
    Q = S.value_histogram(Q, CARD, [DEV], weight="_hp", out=CARD).select(
        DEV, CARD, F.col("n_below").alias("_smaller"))
    pw = Window.partitionBy(DEV, CARD).orderBy("_salt").rowsBetween(UNB, -1)
    pair_off = (P.select(DEV, CARD, "_salt",
                         F.coalesce(F.sum("_pc").over(pw), F.lit(0)).alias("_opc"),
                         F.coalesce(F.sum("_ph").over(pw), F.lit(0)).alias("_oph"))
                .join(Q.select(DEV, CARD, "_smaller"), on=[DEV, CARD], how="inner")
                .select("*", F.lit(PAIR_OFFSET).alias("_kind"), F.lit(SENTINEL).alias(DT),
                        F.lit(SENTINEL).alias(TID)))

    u = s.unionByName(pair_off, allowMissingColumns=True)
    # Device offsets for hot devices: rows, history rows, pairs first seen earlier.
    D = side.where(valid & (F.col("_salt") >= 1)).groupBy(DEV, "_salt").agg(
        F.count(F.lit(1)).alias("_dc"), F.sum("_h").alias("_dh"))
    first_src = P if semantics == "batch" else P.where(F.col("_ph") > 0)
    F2 = (first_src.where(F.col("_salt") >= 1).groupBy(DEV, CARD).agg(F.min("_salt").alias("_salt"))
          .groupBy(DEV, "_salt").agg(F.count(F.lit(1)).alias("_nf")))
    G = D.join(F2, on=[DEV, "_salt"], how="left").fillna(0, ["_nf"])
    dw = Window.partitionBy(DEV).orderBy("_salt").rowsBetween(UNB, -1)
    dev_off = G.select(DEV, "_salt",
                       *[F.coalesce(F.sum(c).over(dw), F.lit(0)).alias("_o" + c[1:]) for c in ("_dc", "_dh", "_nf")],
                       F.lit(OFFSET).alias("_kind"), F.lit(SENTINEL).alias(DT), F.lit(SENTINEL).alias(TID))
    u = u.unionByName(dev_off, allowMissingColumns=True)
    u = K.spread(u, 2 * n_rows, cfg, DEV, "_salt")   # one exchange serves both window families; at most a pair row a row
    return _device_windows(u, semantics, valid, pair_ok, ranked_in_partition=False)


def _device_windows(u: DataFrame, semantics: str, valid: Column, pair_ok: Column,
                    ranked_in_partition: bool) -> DataFrame:
    """W6-W12 windows on rows already partitioned by (DeviceInfo, salt).

    ``ranked_in_partition``: no device is split, so the card rank of W12 is a
    window inside the partition; otherwise it arrives on pair-offset rows."""
    for c in ("_opc", "_oph", "_odc", "_odh", "_onf", "_smaller"):
        if c not in u.columns:
            u = u.withColumn(c, F.lit(None).cast("long"))
    is_row = F.col("_kind") == ROW
    is_poff, is_doff = F.col("_kind") == PAIR_OFFSET, F.col("_kind") == OFFSET
    PP, PD = Window.partitionBy(DEV, CARD, "_salt"), Window.partitionBy(DEV, "_salt")
    z = F.lit(0)

    if semantics == "batch":
        prow = PP.orderBy(DT, TID).rowsBetween(UNB, -1)
        drow = PD.orderBy(DT, TID).rowsBetween(UNB, -1)
        u = u.withColumn("_w10", F.coalesce(F.sum(
            F.when(is_row, 1).when(is_poff, F.col("_opc")).otherwise(z)).over(prow), z))
        u = u.withColumn("_flag", F.when(is_row & pair_ok & (F.col("_w10") == 0), 1).otherwise(z))
        u = (u.withColumn("_w7", F.coalesce(F.sum(
                F.when(is_row, 1).when(is_doff, F.col("_odc")).otherwise(z)).over(drow), z))
             .withColumn("_w8", F.coalesce(F.sum(
                F.when(is_row, F.col("_flag")).when(is_doff, F.col("_onf")).otherwise(z)).over(drow), z)))
    else:
        prange = PP.orderBy(DT).rangeBetween(UNB, -1)
        prow = PP.orderBy(DT, TID).rowsBetween(UNB, -1)
        drange = PD.orderBy(DT).rangeBetween(UNB, -1)
        ph = F.when(is_row, F.col("_h")).when(is_poff, F.col("_oph")).otherwise(z)
        u = (u.withColumn("_w10", F.coalesce(F.sum(ph).over(prange), z))
             .withColumn("_phrows", F.coalesce(F.sum(ph).over(prow), z)))
        u = u.withColumn("_flag", F.when(is_row & pair_ok & (F.col("_h") == 1) & (F.col("_phrows") == 0), 1)
                         .otherwise(z))
        u = (u.withColumn("_w7", F.coalesce(F.sum(
                F.when(is_row, F.col("_h")).when(is_doff, F.col("_odh")).otherwise(z)).over(drange), z))
             .withColumn("_w8", F.coalesce(F.sum(
                F.when(is_row, F.col("_flag")).when(is_doff, F.col("_onf")).otherwise(z)).over(drange), z)))

    if ranked_in_partition:
        # distinct history cards with a smaller number: flag one history row per (device, card),
        # then a range frame over card numbers — all inside the device partition
        first_h = F.row_number().over(PP.orderBy(F.desc("_h"), DT, TID)) == 1
        u = u.withColumn("_fh", F.when(is_row & pair_ok & (F.col("_h") == 1) & first_h, 1).otherwise(z))
        rank_w = Window.partitionBy(DEV, "_salt", pair_ok.alias("_pok")).orderBy(CARD).rangeBetween(UNB, -1)
        u = u.withColumn("_smaller", F.coalesce(F.sum("_fh").over(rank_w), z))
    else:
        u = u.withColumn("_smaller", F.max(F.when(is_poff, F.col("_smaller"))).over(PP))
    u = finish_device(u, semantics, F.col("_w7"), F.col("_w8"), F.col("_w10"), F.col("_smaller"))
    return u.where(is_row).drop(*[c for c in u.columns if c.startswith("_") and c not in ("_h", "_o")])


def finish_device(u: DataFrame, semantics: str, rows: Column, cards: Column, pair_rows: Column, smaller: Column) -> DataFrame:
    """W6-W12 from the running totals: device rows, its distinct cards, pair rows, distinct cards of a smaller number."""
    z, valid = F.lit(0), device_valid(semantics)
    pair_ok = valid & F.col(CARD).isNotNull()
    u = (u.withColumn("has_device_info", valid.cast("int"))
         .withColumn("device_profile_count", F.when(valid, rows).otherwise(z).cast("long"))
         .withColumn("device_profile_unique_cards", F.when(valid, cards).otherwise(z).cast("long"))
         .withColumn("card_device_transaction_count", F.when(pair_ok, pair_rows).otherwise(z).cast("long"))
         .withColumn("card_device_seen_before", (F.col("card_device_transaction_count") > 0).cast("int")))
    if semantics == "batch":
        return (u.withColumn("new_device_profile", (valid & (F.col("device_profile_count") == 0)).cast("int"))
                .withColumn("device_unique_cards_historical",
                            F.when(pair_ok, F.coalesce(smaller, z) + F.col("card_device_seen_before")).otherwise(z).cast("long")))
    return (u.withColumn("new_device_profile", (~valid | (F.col("device_profile_count") == 0)).cast("int"))
            .withColumn("device_unique_cards_historical", F.when(pair_ok, F.coalesce(smaller, z)).otherwise(z).cast("long")))


def behaviour(frame: DataFrame, semantics: str = "batch", skew: SkewConfig | None = None,
              card_src: DataFrame | None = None) -> DataFrame:
    """W1-W12 over a frame with TID, DT, amt, card1, DeviceInfo, ``_h`` (history row) and
    ``_o`` (output row) flags.  ``card_src`` (same rows, card1 and DT) may be a cheaper
    plan to detect hot cards on, e.g. the transactions before the identity join."""
    _check(semantics)
    cfg = skew or SkewConfig()
    n_rows = (card_src if card_src is not None else frame).count()
    return _device_family(_card_family(frame, semantics, cfg, n_rows, card_src), semantics, cfg, n_rows, base=frame)


def build(txns: DataFrame, identity: DataFrame | None = None, raw_columns: Sequence[str] | None = None,
          semantics: str = "batch", skew: SkewConfig | None = None) -> DataFrame:
    """Identity join → basic features → card and device features (unsorted).

    If ``identity`` is None, ``txns`` must already carry DeviceInfo/has_identity.
    """
    _check(semantics)
    df = attach_identity(txns, identity) if identity is not None else txns
    df = basic_features(df, raw_columns)
    frame = df.withColumn("_h", F.lit(1)).withColumn("_o", F.lit(1))
    out = behaviour(frame, semantics, skew, card_src=txns if identity is not None else None)
    return out.drop("_h", "_o")


def feature_store(features: DataFrame) -> DataFrame:
    """Projection to the stored layout: keys + the 21 model features in model order."""
    return features.select(TID, DT, CARD, DEV, *C.MODEL_FEATURES)
