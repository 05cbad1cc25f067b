"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each one reads the shared test tables (through the bindings) in full, and each
has an oracle SQL text of the same name in ``riskloom.plans.oracle`` unless it
is not SQL-expressible (model training, streams).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions.columns import rnd
from riskloom.operators import features as FE
from riskloom.sources import bindings as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


DOUBLE_FEATURES = {"TransactionAmt", "TransactionAmt_log", "card_avg_amount", "amount_vs_card_avg"}
BEHAVIOUR = FE.CARD_FEATURES + FE.DEVICE_FEATURES


def _out(df: DataFrame, names: list[str], key: str = "TransactionID") -> DataFrame:
    cols = [F.col(key)]
    for n in names:
        if n in DOUBLE_FEATURES:
            cols.append(rnd(n).alias(n))
        else:
            cols.append(F.col(n).cast("long").alias(n))
    return df.select(*cols)


# --- W13 / W1-W12 / P1-P6: the feature store ---------------------------------
def feature_table(spark: SparkSession, sf_dir: str, semantics: str) -> DataFrame:
    return FE.build(B.transactions(spark, sf_dir), B.identity(spark, sf_dir), semantics=semantics)


@register("features_batch")
def q_features_batch(spark, sf_dir):
    return _out(feature_table(spark, sf_dir, "batch"), C.MODEL_FEATURES)


@register("features_pit")
def q_features_pit(spark, sf_dir):
    return _out(feature_table(spark, sf_dir, "pit"), C.MODEL_FEATURES)


def _orders_frame(spark, sf_dir):
    return B.order_transactions(spark, sf_dir).withColumn("_h", F.lit(1)).withColumn("_o", F.lit(1))


@register("features_batch_ties")
def q_features_batch_ties(spark, sf_dir):
    return _out(FE.behaviour(_orders_frame(spark, sf_dir), "batch"), BEHAVIOUR)


@register("features_pit_ties")
def q_features_pit_ties(spark, sf_dir):
    return _out(FE.behaviour(_orders_frame(spark, sf_dir), "pit"), BEHAVIOUR)


# --- shared inputs --------------------------------------------------------------
from riskloom.operators import history as H          # noqa: E402
from riskloom.operators import metrics as M          # noqa: E402
from riskloom.operators import ordering as O         # noqa: E402
from riskloom.operators import policy as PO          # noqa: E402
from riskloom.operators import rules as R            # noqa: E402

# Fixed parameters of the registered rule queries (FIXTURES.md §3: the default
# limits never or always fire on this data).
TEST_RULES = R.RuleParams(card_1h_velocity_threshold=2, card_24h_velocity_threshold=5,
                          device_unique_card_threshold=140, high_amount_threshold=150.0,
                          high_risk_model_threshold=0.80, medium_risk_model_threshold=0.60)
PROBE_START = 25 * 86400          # probes: transactions from day 25 on; history: before


def merged(spark, sf_dir):
    """Transactions with their (keep-first) identity device."""
    return FE.attach_identity(B.transactions(spark, sf_dir), B.identity(spark, sf_dir))


def probes_and_history(spark, sf_dir):
    m = merged(spark, sf_dir)
    hist = m.where(F.col("TransactionDT") < PROBE_START)
    dev = F.when(F.col("TransactionID") % 20 == 0, F.lit("unknown-device")).otherwise(F.col("DeviceInfo"))
    probes = m.where(F.col("TransactionDT") >= PROBE_START).withColumn("DeviceInfo", dev)
    return probes, hist


def scored_features(spark, sf_dir):
    """Batch features + the fixed score + label (input of rules and metrics)."""
    f = feature_table(spark, sf_dir, "batch")
    return f.withColumn("score", B.score_expr(F.col("TransactionAmt"), F.col("TransactionDT"))) \
            .withColumn("y", F.col("isFraud"))


# --- J2 / J4 / A6 / A10 -----------------------------------------------------------
@register("identity_keep_first")
def q_identity_keep_first(spark, sf_dir):
    return FE.keep_first(B.identity(spark, sf_dir), "TransactionID", ["DeviceInfo"])


@register("identity_keep_first_duplicates")
def q_identity_keep_first_duplicates(spark, sf_dir):
    """J2 where ids repeat: three events share an id."""
    i = B.identity(spark, sf_dir).withColumn("TransactionID", F.expr("TransactionID div 3"))
    return FE.keep_first(i, "TransactionID", ["DeviceInfo"])


@register("identity_rate_by_label")
def q_identity_rate_by_label(spark, sf_dir):
    m = merged(spark, sf_dir)
    return m.groupBy("isFraud").agg(F.count(F.lit(1)).alias("rows"),
                                    F.sum("has_identity").cast("long").alias("with_identity"),
                                    rnd(F.avg("has_identity")).alias("identity_rate"))


# --- W14 / J9-J13 / A2 / R1 / R2 / A1 ------------------------------------------------
@register("history_lookup")
def q_history_lookup(spark, sf_dir):
    probes, hist = probes_and_history(spark, sf_dir)
    return _out(H.features_21(probes, hist), C.MODEL_FEATURES)


@register("features_tiny_amounts")
def q_features_tiny_amounts(spark, sf_dir):
    """Amounts of 1e-8 and the like: sums are exact, so averages and ratios hold."""
    t = B.transactions(spark, sf_dir).withColumn("TransactionAmt", F.col("TransactionAmt") * 1e-8)
    f = FE.build(t, B.identity(spark, sf_dir), semantics="batch")
    return f.select("TransactionID", rnd("amount_vs_card_avg").alias("amount_vs_card_avg"),
                    rnd(F.col("card_avg_amount") * 1e8).alias("scaled_avg"))


@register("cold_start_flags")
def q_cold_start_flags(spark, sf_dir):
    probes, hist = probes_and_history(spark, sf_dir)
    cs = H.cold_start(H.lookup(probes, hist))
    flags = ["is_new_card", "is_new_device", "is_new_card_device_pair", "card_history_available",
             "device_history_available", "card_device_history_available"]
    return cs.select("TransactionID", *[F.col(c).cast("long").alias(c) for c in flags])


@register("card_profile")
def q_card_profile(spark, sf_dir):
    probes, hist = probes_and_history(spark, sf_dir)
    p = H.card_profile(probes, hist)
    return p.select("TransactionID", F.col("card_history_count").cast("long").alias("card_history_count"),
                    *[rnd(c).alias(c) for c in ("card_history_mean", "card_history_max", "card_history_min")])


# --- R3-R12 / R14 / R16 / R15 ---------------------------------------------------------
def rules_table(spark, sf_dir, model_score=None):
    f = R.cold_start_from_features(scored_features(spark, sf_dir))
    return R.evaluate(f, TEST_RULES, model_score)


@register("rules_batch")
def q_rules_batch(spark, sf_dir):
    r = rules_table(spark, sf_dir)
    return r.select("TransactionID", R.rule_ids().alias("rule_ids"),
                    F.size("rules_triggered").cast("long").alias("n_rules"),
                    rnd("behavioral_risk_score").alias("behavioral_risk_score"), "behavioral_risk_level")


@register("rule_hits_exploded")
def q_rule_hits_exploded(spark, sf_dir):
    r = rules_table(spark, sf_dir, "score")
    return R.explode_hits(r, ["TransactionID"]).withColumn("rule_pos", F.col("rule_pos").cast("long"))


@register("rule_trigger_rate")
def q_rule_trigger_rate(spark, sf_dir):
    r = rules_table(spark, sf_dir)
    return r.agg(F.count(F.lit(1)).alias("rows"),
                 rnd(F.avg((F.size("rules_triggered") > 0).cast("double"))).alias("trigger_rate"))


@register("conservative_score")
def q_conservative_score(spark, sf_dir):
    f = scored_features(spark, sf_dir)
    return f.select("TransactionID", rnd(R.conservative_score(f)).alias("conservative_score"))


# --- D6 / D7 / D11-D14 ----------------------------------------------------------------
@register("fusion_decisions")
def q_fusion_decisions(spark, sf_dir):
    r = rules_table(spark, sf_dir).withColumn("calibrated_model_score", F.col("score"))
    fz = PO.fuse(r, PO.FusionConfig(0.9, 0.1, 0.2618, 0.70))
    return fz.select(
        "TransactionID", rnd("final_risk_score").alias("final_risk_score"), "final_risk_level", "fusion_decision",
        C.tier("score", "model", "level").alias("model_level"), C.tier("score", "model", "decision").alias("model_decision"),
        C.tier("score", "simple", "level").alias("simple_level"),
        C.tier("score", "simple", "decision").alias("simple_decision"),
        C.tier("final_risk_score", "fused", "level").alias("fused_level"),
        PO.fail_closed(PO.decide(F.col("final_risk_score"), F.col("score"), F.col("behavioral_risk_level"))
                       ).alias("final_decision"),
        PO.decide(None, F.col("score"), F.col("behavioral_risk_level")).alias("legacy_decision"))


# --- T1 / T2 / T3 / T4 -------------------------------------------------------------------
@register("time_split")
def q_time_split(spark, sf_dir):
    return O.time_split(B.transactions(spark, sf_dir).select("TransactionID", "TransactionDT")) \
            .select("TransactionID", "split")


@register("temporal_windows")
def q_temporal_windows(spark, sf_dir):
    t = O.time_split(B.transactions(spark, sf_dir).select("TransactionID", "TransactionDT", "isFraud"))
    later = t.where(F.col("split") != "train")
    w, _ = O.temporal_windows(later, "isFraud", 100)
    return w.select("TransactionID", "window")


@register("top_k_review")
def q_top_k_review(spark, sf_dir):
    s = B.scored(spark, sf_dir)
    sel, k, cut = O.top_k(s, "score", 0.05)
    return sel.where("selected").select("TransactionID", "score")


# --- M1 / M2 / M2b / M3 / M6 / M8 / M9 ---------------------------------------------------
def _metric_cols(df):
    return df.select(*[F.col(c).cast("long").alias(c) if c in ("rows", "positives") else
                       (rnd(c).alias(c) if c in ("roc_auc", "average_precision", "pr_auc_trapezoid") else F.col(c))
                       for c in df.columns])


@register("ranking_metrics")
def q_ranking_metrics(spark, sf_dir):
    return _metric_cols(M.ranking_metrics(B.scored(spark, sf_dir), "y", "score"))


@register("ranking_metrics_by_segment")
def q_ranking_metrics_by_segment(spark, sf_dir):
    f = scored_features(spark, sf_dir).withColumn(
        "segment", F.concat(F.when(F.col("new_card") == 1, "new_card").otherwise("existing_card"), F.lit("/"),
                            F.when(F.col("new_device_profile") == 1, "new_device").otherwise("existing_device")))
    return _metric_cols(M.ranking_metrics(f, "y", "score", ["segment"]))


@register("confusion_at_threshold")
def q_confusion(spark, sf_dir):
    c = M.confusion(B.scored(spark, sf_dir), "y", "score", 0.5)
    return c.select(*[F.col(x).cast("long").alias(x) for x in ("tn", "fp", "fn", "tp")],
                    *[rnd(x).alias(x) for x in ("threshold", "precision", "recall", "f1", "fpr", "fnr", "review_rate")])


@register("threshold_sweep")
def q_threshold_sweep(spark, sf_dir):
    t = M.threshold_sweep(B.scored(spark, sf_dir), "y", "score", [i / 10 for i in range(1, 10)])
    return t.select(rnd("threshold").alias("threshold"), *[F.col(x).cast("long").alias(x) for x in ("tn", "fp", "fn", "tp")],
                    *[rnd(x).alias(x) for x in ("precision", "recall", "f1", "fpr", "review_rate")])


@register("brier_score")
def q_brier(spark, sf_dir):
    return M.brier(B.scored(spark, sf_dir), "y", "score").select(rnd("brier").alias("brier"))


@register("calibration_curve_uniform")
def q_calibration_uniform(spark, sf_dir):
    c = M.calibration_curve(B.scored(spark, sf_dir), "y", "score", 10, "uniform")
    return c.select(F.col("bin").cast("long").alias("bin"), F.col("rows").cast("long").alias("rows"),
                    rnd("prob_true").alias("prob_true"), rnd("prob_pred").alias("prob_pred"))


@register("calibration_curve_quantile")
def q_calibration_quantile(spark, sf_dir):
    c = M.calibration_curve(B.scored(spark, sf_dir), "y", "score", 10, "quantile")
    return c.select(F.col("bin").cast("long").alias("bin"), F.col("rows").cast("long").alias("rows"),
                    rnd("prob_true").alias("prob_true"), rnd("prob_pred").alias("prob_pred"))


# --- A3-A20 / U1 / U2 / S13 / S14 -------------------------------------------------------------
from riskloom.operators import profile as PF          # noqa: E402

RAW_COLUMNS = ["TransactionAmt", "card1", "card2", "card3", "card4", "card5", "card6", "addr1", "addr2",
               "DeviceInfo"]


@register("label_frequency")
def q_label_frequency(spark, sf_dir):
    p = PF.label_frequency(B.transactions(spark, sf_dir))
    return p.select("isFraud", "rows", rnd("percent").alias("percent"))


@register("null_shares")
def q_null_shares(spark, sf_dir):
    p = PF.null_shares(merged(spark, sf_dir), RAW_COLUMNS, top=30)
    return p.select("column_name", "nulls", rnd("null_percent").alias("null_percent"))


@register("id_coverage")
def q_id_coverage(spark, sf_dir):
    p = PF.id_coverage(B.transactions(spark, sf_dir), B.identity(spark, sf_dir))
    return p.select("identity_ids", "transaction_ids", rnd("found_percent").alias("found_percent"))


@register("amount_describe_by_label")
def q_amount_describe(spark, sf_dir):
    d = PF.describe_by(B.transactions(spark, sf_dir), "TransactionAmt", ["isFraud"])
    return d.select("isFraud", "count", *[rnd(c).alias(c) for c in ("mean", "std", "min", "p25", "median", "p75", "max")])


@register("amount_by_device_presence")
def q_amount_by_device(spark, sf_dir):
    m = merged(spark, sf_dir).withColumn("has_device", F.col("DeviceInfo").isNotNull().cast("int"))
    d = PF.describe_by(m, "TransactionAmt", ["has_device"])
    return d.select("has_device", "count", *[rnd(c).alias(c) for c in ("min", "max", "mean", "median")])


@register("feature_means_by_label")
def q_feature_means(spark, sf_dir):
    f = feature_table(spark, sf_dir, "batch")
    cols = ["card_transaction_count", "card_txn_count_24h", "device_profile_count", "missing_value_count"]
    m = PF.means_by(f, cols, ["isFraud"])
    return m.select("isFraud", *[rnd(f"mean_{c}").alias(f"mean_{c}") for c in cols])


@register("fraud_rate_by_amount_decile")
def q_rate_by_decile(spark, sf_dir):
    r = PF.rate_by_quantile_bin(B.transactions(spark, sf_dir), "TransactionAmt", "isFraud", 10)
    return r.select(F.col("bin").cast("long").alias("bin"), rnd("lower").alias("lower"), rnd("upper").alias("upper"),
                    "rows", rnd("rate").alias("rate"))


@register("hour_label_crosstab")
def q_crosstab(spark, sf_dir):
    t = B.transactions(spark, sf_dir).withColumn("transaction_hour", C.hour_of_day("TransactionDT"))
    c = PF.crosstab_share(t, "transaction_hour", "isFraud")
    return c.select(F.col("transaction_hour").cast("long").alias("transaction_hour"), "isFraud", "rows",
                    rnd("share").alias("share"))


@register("feature_null_counts")
def q_feature_null_counts(spark, sf_dir):
    f = feature_table(spark, sf_dir, "batch")
    return PF.null_shares(f, C.MODEL_FEATURES).select("column_name", "nulls")


@register("split_summary")
def q_split_summary(spark, sf_dir):
    t = O.time_split(B.transactions(spark, sf_dir))
    s = PF.split_summary(t)
    return s.select("split", "rows", F.col("frauds").cast("long").alias("frauds"),
                    rnd("fraud_percent").alias("fraud_percent"), "min_dt", "max_dt")


@register("velocity_summary")
def q_velocity_summary(spark, sf_dir):
    v = PF.velocity_summary(feature_table(spark, sf_dir, "batch"))
    return v.select(*[F.col(c).cast("long").alias(c) if ("count" in c[-6:] or c.endswith(("_min", "_max", "_nonzero")))
                      else (F.col(c) if c.startswith("invariant") else rnd(c).alias(c)) for c in v.columns])


@register("device_summary")
def q_device_summary(spark, sf_dir):
    d = PF.device_summary(merged(spark, sf_dir))
    return d.select("distinct_devices", rnd("missing_device_percent").alias("missing_device_percent"))


@register("split_union_uniqueness")
def q_union_uniqueness(spark, sf_dir):
    t = O.time_split(B.transactions(spark, sf_dir))
    parts = [t.where(F.col("split") == s) for s in ("train", "validation", "test")]
    return PF.key_uniqueness(PF.union_all(parts))


# --- G1-G3 / G5 / P12 / J14 / P13 / S13 / S14 -----------------------------------------
from riskloom.functions import text as TX            # noqa: E402
from riskloom.operators import records as RC         # noqa: E402
from riskloom.session import ensure_checkpoint_dir     # noqa: E402
from riskloom.sources import history_store as HS       # noqa: E402
from riskloom.sources import io as IO                # noqa: E402

# Fixed parameters of the registered text checks: the reference's lists plus
# phrases/patterns that occur in the shared documents (the defaults never do).
TEST_PHRASES = TX.FORBIDDEN_PHRASES + ["password"]
TEST_PATTERNS = TX.SECRET_PATTERNS + [r'token = "[0-9a-f]+"', r"AKIA[0-9A-Z]{16}"]


def report_table(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("text").alias("report"), (F.col("n_chars") % 10).cast("string").alias("risk_score"),
                    F.lit("en").alias("risk_level"), F.lit("ti").alias("decision"))


@register("report_guardrail")
def q_report_guardrail(spark, sf_dir):
    return TX.validate_reports(report_table(spark, sf_dir), ["doc_id"], phrases=TEST_PHRASES, patterns=TEST_PATTERNS)


@register("report_guardrail_nulls")
def q_report_guardrail_nulls(spark, sf_dir):
    """The same checks where reports and expected values are missing: every such row fails."""
    r = report_table(spark, sf_dir)
    gone = lambda c, k: F.when(F.col("doc_id") % 5 != k, F.col(c)).alias(c)
    r = r.select("doc_id", gone("report", 1), gone("risk_score", 2), gone("risk_level", 3), gone("decision", 4))
    return TX.validate_reports(r, ["doc_id"], phrases=TEST_PHRASES, patterns=TEST_PATTERNS)


def id_requests(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("event_id")
    k = F.col("event_id") % 4
    raw = (F.when(k == 0, F.col("event_id").cast("string"))
           .when(k == 1, (-F.col("event_id")).cast("string"))
           .when(k == 2, F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(" ")))
           .otherwise(F.concat(F.lit("id"), F.col("event_id").cast("string"))))
    return e.select("event_id", raw.alias("raw_id"))


@register("id_validation")
def q_id_validation(spark, sf_dir):
    good, bad = RC.split_ids(id_requests(spark, sf_dir))
    return good.select("event_id", "TransactionID", F.lit(None).cast("string").alias("reason")) \
        .unionByName(bad.select("event_id", "TransactionID", "reason"))


def payloads(spark, sf_dir):
    """Every transaction becomes a request: matching (card1, DT) with a new amount, an
    unmatched time (synthetic), or a matching key without an amount field (base amount kept)."""
    t = B.transactions(spark, sf_dir)
    k = F.col("TransactionID") % 3
    dt = F.when(k == 1, F.col("TransactionDT") + 7).otherwise(F.col("TransactionDT"))
    keys = F.create_map(F.lit("card1"), F.col("card1").cast("string"), F.lit("TransactionDT"), dt.cast("string"))
    amt = F.create_map(F.lit("TransactionAmt"), (F.col("TransactionAmt") * 2).cast("string"))
    p = F.when(k == 2, keys).otherwise(F.map_concat(keys, amt))
    return t.select(F.col("TransactionID").alias("request_id"), p.alias("payload"))


@register("payload_overlay")
def q_payload_overlay(spark, sf_dir):
    o = RC.payload_requests(payloads(spark, sf_dir), merged(spark, sf_dir))
    return o.select("request_id", F.col("synthetic").cast("long").alias("synthetic"), *RC.TXN_FIELDS, "completeness")


@register("stored_row_lookup")
def q_stored_row_lookup(spark, sf_dir):
    """P10: every id, some of which are not stored."""
    asked = B.table(spark, sf_dir, "events").select((F.col("event_id") + 3).alias("TransactionID"))
    found = RC.find_stored(asked, B.transactions(spark, sf_dir).select("TransactionID", "TransactionDT"))
    return found.select("TransactionID", F.coalesce("TransactionDT", F.lit(-1).cast("long")).alias("TransactionDT"), "found")


@register("stored_row_repeated_ids")
def q_stored_row_repeated_ids(spark, sf_dir):
    """P10: every order asks for its customer's earliest order, ids repeated on both sides."""
    orders = B.table(spark, sf_dir, "orders")
    stored = orders.select(F.col("o_custkey").alias("TransactionID"),
                           F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("TransactionDT"), "o_orderkey")
    asked = orders.select((F.col("o_custkey") + F.col("o_orderkey") % 2).alias("TransactionID"), F.col("o_orderkey").alias("asked_by"))
    found = RC.find_stored(asked, stored)
    return found.select("asked_by", "TransactionID", F.coalesce("TransactionDT", F.lit(-1).cast("long")).alias("TransactionDT"),
                        F.coalesce("o_orderkey", F.lit(-1).cast("long")).alias("first_order"), "found")


@register("history_by_days")
def q_history_by_days(spark, sf_dir):
    """The history stored in three goes that overlap, then read up to the middle of its time."""
    t = B.transactions(spark, sf_dir).select("TransactionID", "TransactionDT", "TransactionAmt", "card1")
    path = f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    for part in ("TransactionID % 2 = 0", "TransactionID % 3 <> 0", "true"):
        HS.add_rows(t.where(part), path)
    ends = t.agg(F.min("TransactionDT").alias("a"), F.max("TransactionDT").alias("z")).first()
    days = HS.read_days(spark, path, last=(ends.a + ends.z) // 2 // HS.DAY_SECONDS)
    return days.select("day", "TransactionID", "TransactionDT", "card1")


@register("rejected_lines")
def q_rejected_lines(spark, sf_dir):
    """Transactions as CSV lines, some with words, fractions or missing fields; all lines come back."""
    tid, dt = F.col("TransactionID"), F.col("TransactionDT").cast("string")
    time = F.when(tid % 7 == 0, F.lit("noon")).when(tid % 13 == 0, F.concat(dt, F.lit(".5"))).when(tid % 17 != 0, dt).otherwise("")
    line = F.when(tid % 11 == 0, F.concat_ws(",", tid, time)).otherwise(F.concat_ws(",", tid, time, F.lit("x"), tid % 5))
    lines = B.transactions(spark, sf_dir).select(line.alias("value"))
    schema = IO.T.StructType([f for f in IO.TRANSACTION_SCHEMA if f.name in ("TransactionID", "TransactionDT", "card1")])
    good, rejected = IO.parse_lines(lines, ["TransactionID", "TransactionDT", "V1", "card1"], schema)
    none = F.lit(-1).cast("long")
    return good.select("TransactionID", F.coalesce("TransactionDT", none).alias("TransactionDT"), "card1", F.lit("").alias("line")) \
        .unionAll(rejected.select(none, none, none, "line"))


@register("cold_start_null_keys")
def q_cold_start_null_keys(spark, sf_dir):
    """R2: probes without a card (even ids) or without a time (odd ids)."""
    probes, hist = probes_and_history(spark, sf_dir)
    even = F.col("TransactionID") % 2 == 0
    probes = (probes.withColumn("card1", F.when(~even, F.col("card1")))
              .withColumn("TransactionDT", F.when(even, F.col("TransactionDT"))))
    c = H.cold_start(H.lookup(probes, hist))
    return c.select("TransactionID", *[F.col(a).cast("long").alias(b) for a, b in (
        ("is_new_card", "is_new_card"), ("is_new_device", "is_new_device"), ("is_new_card_device_pair", "is_new_pair"))])


@register("feedback_validation")
def q_feedback_validation(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    lab = (F.when(F.col("event_type") == "error", "CONFIRMED_FRAUD").when(F.col("event_type") == "click", "FALSE_POSITIVE")
           .when(F.col("event_type") == "view", "LEGITIMATE").when(F.col("event_type") == "purchase", "NEEDS_MORE_INFORMATION")
           .otherwise(F.lower(F.col("event_type"))))
    raw = e.select(F.col("event_id").alias("transaction_id"), lab.alias("analyst_label"))
    acc, rej = IO.validate_feedback(raw, TX.FEEDBACK_LABELS)
    return acc.select("transaction_id", "analyst_label", F.lit(1).alias("accepted")) \
        .unionByName(rej.select("transaction_id", "analyst_label", F.lit(0).alias("accepted")))


@register("label_join_contract")
def q_label_join_contract(spark, sf_dir):
    f = feature_table(spark, sf_dir, "batch").drop("isFraud")
    labels = B.transactions(spark, sf_dir).select("TransactionID", "isFraud")
    _, rep = IO.labelled_join(f, labels)
    return rep.select(*[F.col(c).cast("long").alias(c) for c in rep.columns])


@register("label_join_unlabelled")
def q_label_join_unlabelled(spark, sf_dir):
    """S14 where every fifth row has no label and every seventh label row is there twice."""
    t = B.transactions(spark, sf_dir)
    labels = t.select("TransactionID", "isFraud").where(F.col("TransactionID") % 5 != 0)
    labels = labels.unionAll(labels.where(F.col("TransactionID") % 7 == 0))
    _, rep = IO.labelled_join(t.select("TransactionID", "TransactionAmt"), labels)
    return rep.select(*[F.col(c).cast("long").alias(c) for c in rep.columns])


# --- W15 / W16 ----------------------------------------------------------------------------
@register("features_test_split")
def q_features_test_split(spark, sf_dir):
    cuts = O.split_cuts(B.transactions(spark, sf_dir))
    f = O.apply_split(feature_table(spark, sf_dir, "batch"), cuts)
    return _out(f.where(F.col("split") == "test"), BEHAVIOUR)


@register("batch_pit_parity")
def q_batch_pit_parity(spark, sf_dir):
    from riskloom.plans import parity
    return parity.parity_report(feature_table(spark, sf_dir, "batch"), feature_table(spark, sf_dir, "pit"),
                                BEHAVIOUR)


# --- M10-M12 --------------------------------------------------------------------------------
@register("fusion_weight_search")
def q_fusion_weight_search(spark, sf_dir):
    from riskloom.plans import jobs as J
    r = rules_table(spark, sf_dir)
    grid = J.weight_grid(r, "y", "score", "behavioral_risk_score")
    return grid.select(rnd("model_weight").alias("model_weight"), rnd("recall").alias("recall_at_5pct"),
                       rnd("precision").alias("precision_at_5pct"),
                       *[rnd(c).alias(c) for c in ("review_threshold", "high_threshold", "f1")], "chosen")


# --- M4 / M4b / M5 / M7 / M13 / M14-M16 / M19 / T3 / T6: exact cuts in shared rounds -------------------
def _review_rows(spark, rows):
    """Rows (name, metrics) of bounded reports."""
    out = [(name, m["rows"], m["review_count"], m["selected_fraud_count"], m["recall"], m["precision"], m["cutoff_score"])
           for name, m in rows]
    t = spark.createDataFrame(out, "name string, rows long, review_count long, selected_fraud_count long, "
                                   "recall double, precision double, cutoff_score double")
    return t.select("name", "rows", "review_count", "selected_fraud_count",
                    *[rnd(c).alias(c) for c in ("recall", "precision", "cutoff_score")])


@register("review_capacity_sweep")
def q_capacity_sweep(spark, sf_dir):
    """Three capacities, k rounded up and down."""
    s = B.scored(spark, sf_dir)
    rates = (0.01, 0.05, 0.10)
    return _review_rows(spark, [(f"{how}_{r:.2f}", m) for how in ("ceil", "floor")
                                for r, m in zip(rates, M.capacity_sweep(s, "y", "score", rates, how))])


def _gappy_scores(spark, sf_dir):
    """Scores with ids above 2^53 and missing (null, NaN) scores: T1-T4 must stay exact."""
    e = F.col("TransactionID") % 7
    score = F.when(e == 0, F.lit(None).cast("double")).when(e == 1, F.lit(float("nan"))).otherwise(F.round("score", 1))
    return B.scored(spark, sf_dir).withColumn("score", score) \
        .withColumn("TransactionID", F.col("TransactionID") + F.lit(1 << 60)).withColumn("TransactionDT", F.lit(7).cast("long"))


@register("top_k_large_ids")
def q_top_k_large_ids(spark, sf_dir):
    sel, _, _ = O.top_k(_gappy_scores(spark, sf_dir), "score", 0.80)      # reaches into the missing scores
    return sel.where("selected").select("TransactionID")


@register("time_split_large_ids")
def q_time_split_large_ids(spark, sf_dir):
    return O.time_split(_gappy_scores(spark, sf_dir)).select("TransactionID", "split")


@register("fusion_stability")
def q_fusion_stability(spark, sf_dir):
    """M13 on the fixed score."""
    from riskloom.plans import jobs as J
    g = J.fusion_gain(rules_table(spark, sf_dir), "y", "score", "behavioral_risk_score", 0.8)
    names = ("baseline_recall", "baseline_precision", "fusion_recall", "fusion_precision", "recall_change", "precision_change")
    t = spark.createDataFrame([(int(g["enabled"]), *[g[n] for n in names])],
                              "enabled long, " + ", ".join(f"{n} double" for n in names))
    return t.select("enabled", *[rnd(n).alias(n) for n in names])


def _segment_deltas(spark, sf_dir):
    from riskloom.plans import jobs as J
    f = scored_features(spark, sf_dir)
    f = f.withColumn("fused", F.lit(0.8) * F.col("score") + F.lit(0.2) * R.conservative_score(f))
    return M.segment_review(f, "y", ["score", "fused"], J.diagnostic_segments(), 0.05)


@register("segment_review")
def q_segment_review(spark, sf_dir):
    """Rows, frauds, fraud rate, review count, recall and precision of two scores in 17 segments."""
    rows = [(r["segment"], r["score"], r["rows"], r["frauds"], r["review_count"], r["fraud_rate"], r["recall"], r["precision"])
            for r in _segment_deltas(spark, sf_dir)]
    t = spark.createDataFrame(rows, "segment string, score string, rows long, frauds long, review_count long, "
                                    "fraud_rate double, recall double, precision double")
    return t.select("segment", "score", "rows", "frauds", "review_count",
                    *[rnd(c).alias(c) for c in ("fraud_rate", "recall", "precision")])


@register("segment_extremes")
def q_segment_extremes(spark, sf_dir):
    """The five worst and best segments by change of recall."""
    from riskloom.plans import jobs as J
    pairs = J.segment_pairs(_segment_deltas(spark, sf_dir), "score", "fused")
    deltas = [(n, *(None if b[k] is None else round(f[k] - b[k], 9) for k in ("recall", "precision"))) for n, b, f in pairs]
    worst, best = J.extreme_segments(deltas)
    rows = [(kind, i + 1, d[0], d[1]) for kind, ds in (("worst", worst), ("best", best)) for i, d in enumerate(ds)]
    return spark.createDataFrame(rows, "kind string, place long, segment string, change double").select(
        "kind", "place", "segment", rnd("change").alias("change"))


@register("cold_start_segment_points")
def q_segment_points(spark, sf_dir):
    """Confusion and review metrics of the four cold-start segments."""
    f = scored_features(spark, sf_dir).withColumn(
        "segment", F.concat(F.when(F.col("new_card") == 1, "new_card").otherwise("existing_card"), F.lit("/"),
                            F.when(F.col("new_device_profile") == 1, "new_device").otherwise("existing_device")))
    from riskloom.session import cut_lineage
    f = cut_lineage(f.select("TransactionID", "TransactionDT", "y", "score", "segment"))
    conf = M.confusion(f, "y", "score", 0.5, ["segment"])
    found = M.review_groups(f, "y", "score", [0.05], group="segment")
    points = spark.createDataFrame([(g, m["review_count"], m["recall"], m["precision"]) for (g, _), m in found.items()],
                                   "segment string, review_count long, recall_at_5pct double, precision_at_5pct double")
    return conf.join(points, "segment").select(
        "segment", *[F.col(x).cast("long").alias(x) for x in ("tn", "fp", "fn", "tp")], "review_count",
        *[rnd(x).alias(x) for x in ("precision", "recall", "f1", "recall_at_5pct", "precision_at_5pct")])


# --- X1-X3 (streams driven to completion with availableNow) ----------------------------------------
def _stream_transactions(spark, sf_dir):
    """The events → transactions binding applied to a file stream of ``events``."""
    from riskloom.streaming import jobs as SJ
    return B.as_transactions(SJ.file_stream(spark, sf_dir, "events"))


@register("stream_scoring")
def q_stream_scoring(spark, sf_dir):
    from riskloom.operators import profiles as PR
    from riskloom.streaming import jobs as SJ
    base = SJ.stream_dir(spark, "scoring")
    store = PR.ProfileStore(spark, f"{base}/profiles")
    store.add(merged(spark, sf_dir).where(F.col("TransactionDT") < PROBE_START))
    arrivals = _stream_transactions(spark, sf_dir).where(F.col("TransactionDT") >= PROBE_START)
    model = lambda d: B.score_expr(F.col("TransactionAmt"), F.col("TransactionDT"))     # noqa: E731 - the fixed score
    SJ.run_to_end(SJ.score_arrivals(arrivals, store, f"{base}/out", f"{base}/ckpt", TEST_RULES, model=model,
                                    identity=B.identity(spark, sf_dir)))
    out = spark.read.parquet(f"{base}/out")
    extra = ("rule_ids", "behavioral_risk_level", "final_risk_level", "decision")
    kept = out.select("TransactionID", *extra, rnd("model_score").alias("model_score"), rnd("final_risk_score").alias("final_risk_score"))
    return _out(out, C.MODEL_FEATURES).join(kept, "TransactionID")


@register("profile_lookup")
def q_profile_lookup(spark, sf_dir):
    """W14 answered from maintained profiles that grew in three epochs; equals ``history_lookup``."""
    from riskloom.operators import profiles as PR
    from riskloom.streaming import jobs as SJ
    probes, hist = probes_and_history(spark, sf_dir)
    store = PR.ProfileStore(spark, SJ.stream_dir(spark, "profiles"))
    for epoch in range(3):
        store.add(hist.where(F.pmod(F.col("TransactionID"), F.lit(3)) == epoch), epoch)
    return _out(PR.answer(FE.basic_features(probes), store, 3), C.MODEL_FEATURES)


@register("stream_velocity")
def q_stream_velocity(spark, sf_dir):
    from riskloom.streaming import jobs as SJ
    base = SJ.stream_dir(spark, "velocity")
    q = (SJ.card_velocity(_stream_transactions(spark, sf_dir)).writeStream.format("parquet")
         .option("path", f"{base}/out").option("checkpointLocation", f"{base}/ckpt")
         .outputMode("append").trigger(availableNow=True).start())
    SJ.run_to_end(q)
    return spark.read.parquet(f"{base}/out").select("TransactionID", "card_txn_count_1h", "card_txn_count_24h")


@register("stream_feedback")
def q_stream_feedback(spark, sf_dir):
    from riskloom.streaming import jobs as SJ
    e = SJ.file_stream(spark, sf_dir, "events")
    lab = (F.when(F.col("event_type") == "error", "CONFIRMED_FRAUD").when(F.col("event_type") == "click", "FALSE_POSITIVE")
           .when(F.col("event_type") == "view", "LEGITIMATE").when(F.col("event_type") == "purchase", "NEEDS_MORE_INFORMATION")
           .otherwise(F.lower(F.col("event_type"))))
    fb = e.select(F.col("event_id").alias("transaction_id"), lab.alias("analyst_label"))
    base = SJ.stream_dir(spark, "feedback")
    SJ.run_to_end(SJ.feedback_sink(fb, f"{base}/out", f"{base}/ckpt"))
    return spark.read.parquet(f"{base}/out").select("transaction_id", "analyst_label")


# --- D1-D5 / D9 / D10 / D15-D18 / G4 / M17-M20 (trained models: rows-only checks) --------------------
from riskloom.operators import ml as ML               # noqa: E402

QUERY_GBT: dict = {}      # the library's model size


def _train_test(spark, sf_dir):
    cuts = O.split_cuts(B.transactions(spark, sf_dir))
    f = O.apply_split(feature_table(spark, sf_dir, "batch"), cuts)
    from riskloom.session import cut_lineage
    f = cut_lineage(f)
    return f.where(F.col("split") == "train"), f.where(F.col("split") == "test")


@register("model_scores_gbt")
def q_model_scores_gbt(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    m = ML.train_gbt(train, **QUERY_GBT)
    return ML.score(m, test, keep=("TransactionID", "isFraud")).select("TransactionID", "isFraud", "model_score")


@register("model_scores_logistic")
def q_model_scores_logistic(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    m = ML.train_logistic(train)
    return ML.score(m, test, keep=("TransactionID", "isFraud")).select("TransactionID", "isFraud", "model_score")


@register("ablation_missing_features")
def q_ablation(spark, sf_dir):
    """The same model with and without the three missing-data features."""
    train, test = _train_test(spark, sf_dir)
    rows = []
    for name, feats in (("all_features", C.MODEL_FEATURES),
                        ("without_missing_data", [f for f in C.MODEL_FEATURES if f not in C.MISSING_DATA_FEATURES])):
        m = ML.train_gbt(train, features=feats, **QUERY_GBT)
        r = M.ranking_metrics(ML.score(m, test, keep=("isFraud",)), "isFraud", "model_score").collect()[0]
        rows.append((name, r["roc_auc"], r["average_precision"]))
    return spark.createDataFrame(rows, "variant string, roc_auc double, average_precision double")


@register("isotonic_calibration")
def q_isotonic(spark, sf_dir):
    """Train on the train split, fit the calibrator on the whole validation split, apply to test."""
    from riskloom.session import cut_lineage
    cuts = O.split_cuts(B.transactions(spark, sf_dir))
    f = cut_lineage(O.apply_split(feature_table(spark, sf_dir, "batch"), cuts))
    model = ML.train_gbt(f.where(F.col("split") == "train"), **QUERY_GBT)
    keep = ("TransactionID", "isFraud")
    iso = ML.fit_isotonic(ML.score(model, f.where(F.col("split") == "validation"), keep=keep), "model_score", "isFraud")
    test = ML.score(model, f.where(F.col("split") == "test"), keep=keep)
    return ML.calibrate(iso, test, "model_score").select("TransactionID", "model_score", "calibrated_model_score")


@register("tree_explanations")
def q_tree_explanations(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    m = ML.train_gbt(train, **QUERY_GBT)
    return ML.evidence_rows(ML.tree_contributions(m, test), ["TransactionID"], 5)


@register("linear_explanations")
def q_linear_explanations(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    m = ML.train_logistic(train)
    return ML.evidence_rows(ML.linear_contributions(m, test), ["TransactionID"], 5)


@register("global_importance")
def q_global_importance(spark, sf_dir):
    train, test = _train_test(spark, sf_dir)
    m = ML.train_gbt(train, **QUERY_GBT)
    return ML.global_importance(ML.tree_contributions(m, test))


def _investigations(spark, sf_dir):
    """D18 on the fixed score; the evidence are the two terms of its logit, the stronger first."""
    probes, hist = probes_and_history(spark, sf_dir)
    score = B.score_expr(F.col("TransactionAmt"), F.col("TransactionDT"))
    probes = probes.withColumn("score", F.when(F.col("TransactionID") % 9 != 0, score))      # some scores fail
    terms = [F.struct(F.lit("TransactionAmt_log").alias("feature"), F.round(F.log1p("TransactionAmt"), 3).alias("weight")),
             F.struct(F.lit("transaction_hour").alias("feature"),
                      F.round(F.lit(0.05) * F.pmod(F.floor(F.col("TransactionDT") / 3600), F.lit(24)), 3).alias("weight"))]
    probes = probes.withColumn("evidence", F.when(terms[0]["weight"] >= terms[1]["weight"], F.array(*terms))
                               .otherwise(F.array(*terms[::-1])))
    return RC.investigate(probes, hist, TEST_RULES, model_score="score", evidence="evidence")


EXPLAINED = [f for f in C.MODEL_FEATURES if f != "TransactionAmt_log"]


def _fixed_contributions(spark, sf_dir):
    """Contributions that any engine can compute: value times a fixed weight, the sign by the parity of the id."""
    f = feature_table(spark, sf_dir, "batch")
    sign = F.when(F.col("TransactionID") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    value = lambda c: rnd(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 1)      # noqa: E731 - no halves to round
    each = [F.struct(F.lit(c).alias("feature"), value(c).alias("value"), (sign * F.lit((i + 1) / 8) * value(c)).alias("contribution"))
            for i, c in enumerate(EXPLAINED)]
    return f.select("TransactionID", F.array(*each).alias("contributions"))


@register("explanation_sentences")
def q_explanation_sentences(spark, sf_dir):
    """The five strongest contributions of every row with impact and sentence."""
    e = ML.evidence_rows(_fixed_contributions(spark, sf_dir), ["TransactionID"], 5)
    return e.select("TransactionID", F.col("rank").cast("long").alias("rank"), "feature", "impact", "explanation")


@register("global_importance_fixed")
def q_global_importance_fixed(spark, sf_dir):
    """D17 on the fixed contributions."""
    g = ML.global_importance(_fixed_contributions(spark, sf_dir))
    return g.select("feature", F.round("mean_abs_contribution", 3).alias("mean_abs_contribution"))


@register("investigation_records")
def q_investigation_records(spark, sf_dir):
    r = RC.flat_record(_investigations(spark, sf_dir))
    first = F.get_json_object("evidence", "$[0].feature")
    rounded = {"model_score", "behavioral_score", "final_risk_score", "card_average_amount", "card_max_amount", "card_min_amount"}
    return r.withColumn("evidence", first).select(*[
        rnd(c).alias(c) if c in rounded else F.col(c).cast("long").alias(c) if t in ("boolean", "int") else F.col(c)
        for c, t in r.dtypes])


@register("investigation_context")
def q_investigation_context(spark, sf_dir):
    """The records as JSON text."""
    return RC.to_json_context(_investigations(spark, sf_dir))


def _job(spark, sf_dir, fn, part=0):
    from riskloom.plans import jobs as J
    # windows of the 70/15/15 split sized for the smallest test data; everything else is the default
    cfg = J.EvalConfig(min_frauds=5, min_rows=20)
    out = fn(spark, B.transactions(spark, sf_dir), B.identity(spark, sf_dir), cfg)
    return out[part] if isinstance(out, tuple) else out


@register("job_system_evaluation")
def q_job_eval(spark, sf_dir):
    from riskloom.plans import jobs as J
    return _job(spark, sf_dir, J.evaluation_job)


@register("job_ranked_production")
def q_job_ranked(spark, sf_dir):
    from riskloom.plans import jobs as J
    return _job(spark, sf_dir, J.ranked_production_job)


@register("job_ranked_selection")
def q_job_ranked_selection(spark, sf_dir):
    """The rows that the ranked production job selects."""
    from riskloom.plans import jobs as J
    return _job(spark, sf_dir, J.ranked_production_job, 1)


@register("job_fusion_diagnostics")
def q_job_diag(spark, sf_dir):
    from riskloom.plans import jobs as J
    return _job(spark, sf_dir, J.fusion_diagnostics_job)


@register("job_evaluate_and_calibrate")
def q_job_calibrate(spark, sf_dir):
    from riskloom.plans import jobs as J
    return _job(spark, sf_dir, J.evaluate_and_calibrate_job)


@register("job_evaluate_and_calibrate_fixed")
def q_job_calibrate_fixed(spark, sf_dir):
    """M20 with D9 / D10 on the fixed score: split, isotonic fit on validation, metrics and curve on test."""
    from riskloom.plans import jobs as J
    cfg = J.EvalConfig(score=B.score_expr(F.col("TransactionAmt"), F.col("TransactionDT")))
    out = J.evaluate_and_calibrate_job(spark, B.transactions(spark, sf_dir), B.identity(spark, sf_dir), cfg)
    return out.withColumn("value", rnd("value"))


# --- T7-T10 / P16 / P17 / J5 -------------------------------------------------------------------
@register("best_threshold_by_f1")
def q_best_threshold(spark, sf_dir):
    grid = [round(0.05 * i, 2) for i in range(1, 20)]
    sweep = M.threshold_sweep(B.scored(spark, sf_dir), "y", "score", grid)
    b = PF.best_threshold(sweep)
    return b.select(rnd("threshold").alias("threshold"), rnd("f1").alias("f1"),
                    *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")])


@register("highest_score_row")
def q_highest(spark, sf_dir):
    return PF.highest(B.scored(spark, sf_dir), "score").select("TransactionID", "TransactionDT", "score", "y")


@register("earliest_latest_rows")
def q_extremes(spark, sf_dir):
    t = B.transactions(spark, sf_dir).select("TransactionID", "TransactionDT", "TransactionAmt", "isFraud")
    return PF.extremes(t, 5)


@register("seeded_sample")
def q_seeded_sample(spark, sf_dir):
    return PF.seeded_sample(B.transactions(spark, sf_dir).select("TransactionID", "TransactionDT", "isFraud"), 5000)


@register("device_fill_and_known_ids")
def q_device_fill(spark, sf_dir):
    """P16 + P17 + J5: orders keep their own priority as device unless missing; then the
    rows whose id is also an event id are kept."""
    o = B.order_transactions(spark, sf_dir)
    o = o.withColumn("DeviceInfo", F.when(F.col("TransactionID") % 3 == 0, F.lit(None).cast("string"))
                     .otherwise(F.col("DeviceInfo")))
    filled = PF.drop_if_present(PF.fill_device(o, B.identity(spark, sf_dir)), ["isFraud", "not_a_column"])
    known = PF.keep_known(filled, B.transactions(spark, sf_dir))
    return known.select("TransactionID", "card1", "DeviceInfo")


@register("assessment_records")
def q_assessment_records(spark, sf_dir):
    """(id, score, level, decision) under the simple tier policy, flat."""
    s = B.scored(spark, sf_dir).withColumn("risk", PO.assessment("TransactionID", "score", None, "simple"))
    return s.select("risk.transaction_id", "risk.risk_score", "risk.risk_level", "risk.decision")


# --- the hot-key (split) plan must give the same answers ----------------------------------------
from riskloom.operators.keyed import SkewConfig as _Skew      # noqa: E402

# Fixed parameters: low enough that every device and most cards are split here.
SPLIT_EVERYTHING = _Skew(min_hot_rows=40, target_rows=20, null_spread=16)


@register("features_batch_hot_keys")
def q_features_batch_hot(spark, sf_dir):
    f = FE.build(B.transactions(spark, sf_dir), B.identity(spark, sf_dir), semantics="batch", skew=SPLIT_EVERYTHING)
    return _out(f, C.MODEL_FEATURES)


@register("features_pit_hot_keys")
def q_features_pit_hot(spark, sf_dir):
    f = FE.build(B.transactions(spark, sf_dir), B.identity(spark, sf_dir), semantics="pit", skew=SPLIT_EVERYTHING)
    return _out(f, C.MODEL_FEATURES)


@register("history_lookup_hot_keys")
def q_history_lookup_hot(spark, sf_dir):
    probes, hist = probes_and_history(spark, sf_dir)
    return _out(H.lookup(probes, hist, SPLIT_EVERYTHING), BEHAVIOUR)


def crowded(spark, sf_dir):
    """A third of all rows with one card and one device inside one day."""
    t = merged(spark, sf_dir)
    third = F.col("TransactionID") % 3 == 0
    return (t.withColumn("card1", F.when(third, F.lit(7).cast("long")).otherwise(F.col("card1")))
            .withColumn("DeviceInfo", F.when(third, F.lit("crowd")).otherwise(F.col("DeviceInfo")))
            .withColumn("TransactionDT", F.when(third, F.lit(10 * 86_400) + F.pmod("TransactionDT", F.lit(86_400)))
                        .otherwise(F.col("TransactionDT"))))


@register("features_crowded_day")
def q_features_crowded_day(spark, sf_dir):
    f = FE.build(crowded(spark, sf_dir), semantics="batch", skew=SPLIT_EVERYTHING)
    return _out(f, BEHAVIOUR)


@register("features_crowded_day_pit")
def q_features_crowded_day_pit(spark, sf_dir):
    f = FE.build(crowded(spark, sf_dir), semantics="pit", skew=SPLIT_EVERYTHING)
    return _out(f, BEHAVIOUR)
