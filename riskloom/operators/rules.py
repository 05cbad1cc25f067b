"""Deterministic rules (R3-R16) as column expressions over a whole table."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C

# Rule ids, severities and reason texts (in rule order).
RULE_ORDER = ["HIGH_MODEL_RISK", "MEDIUM_MODEL_RISK", "NEW_CARD_NEW_DEVICE_HIGH_AMOUNT", "NEW_CARD",
              "NEW_DEVICE", "HIGH_CARD_VELOCITY", "SHARED_DEVICE", "UNUSUAL_AMOUNT"]
SEVERITY = {"HIGH_MODEL_RISK": "HIGH", "MEDIUM_MODEL_RISK": "MEDIUM", "NEW_CARD_NEW_DEVICE_HIGH_AMOUNT": "MEDIUM",
            "NEW_CARD": "MEDIUM", "NEW_DEVICE": "MEDIUM", "HIGH_CARD_VELOCITY": "HIGH", "SHARED_DEVICE": "HIGH",
            "UNUSUAL_AMOUNT": "MEDIUM"}
REASON_HIGH_MODEL = "Model risk score (%s) meets or exceeds high threshold (%s)."
REASON_MEDIUM_MODEL = "Model risk score (%s) meets or exceeds medium threshold (%s)."
REASON_BOTH_NEW = ("Transaction uses both a new card and a new device with a high amount ($%s >= $%s); "
                   "no prior history exists, so this is treated as a moderate signal rather than automatic high risk.")
REASON_NEW_CARD = ("The payment card has no prior observed history; this is treated as a contextual signal, "
                   "not proof of fraud.")
REASON_NEW_DEVICE = ("The transaction device has no prior observed history; this is treated as a contextual signal, "
                     "not proof of fraud.")
REASON_VELOCITY = "High card transaction velocity detected (1h count: %s, 24h count: %s)."
REASON_SHARED = "Device is associated with multiple unique cards (%s >= %s)."
REASON_UNUSUAL = "Transaction amount is significantly higher than historical card average (ratio: %s)."
# Behaviour score by severity mix: >=2 HIGH, 1 HIGH, >=2 MEDIUM, 1 MEDIUM, none.
SCORE_TABLE = [(0.90, "HIGH"), (0.85, "HIGH"), (0.65, "MEDIUM"), (0.50, "MEDIUM"), (0.0, "LOW")]


@dataclass(frozen=True)
class RuleParams:
    """Rule thresholds (defaults are the reference's settings)."""
    high_risk_model_threshold: float = 0.90
    medium_risk_model_threshold: float = 0.70
    high_amount_threshold: float = 500.0
    device_unique_card_threshold: int = 3
    card_1h_velocity_threshold: int = 5
    card_24h_velocity_threshold: int = 20
    unusual_amount_ratio_threshold: float = 3.0

    def replace(self, **kw) -> "RuleParams":
        vals = {f.name: getattr(self, f.name) for f in fields(self)}
        vals.update(kw)
        return RuleParams(**vals)


def _num_text(x: float) -> str:
    """Python-style text of a threshold (0.9 → '0.9', 3 → '3')."""
    return repr(x) if isinstance(x, float) else str(x)


def _fmt_g(c: Column) -> Column:
    """``%g``-like text for counts: integral values without a decimal point."""
    return F.when(c == F.floor(c), F.floor(c).cast("long").cast("string")).otherwise(c.cast("string"))


def _hit(rule_id: str, reason: Column) -> Column:
    return F.struct(F.lit(rule_id).alias("rule_id"), F.lit(SEVERITY[rule_id]).alias("severity"),
                    reason.alias("reason"))


def cold_start_from_features(df: DataFrame) -> DataFrame:
    """Cold-start flags from stored features (new_card, new_device_profile, seen_before)."""
    nc = F.coalesce(F.col("new_card"), F.lit(0)) != 0
    nd = F.coalesce(F.col("new_device_profile"), F.lit(0)) != 0
    seen = F.coalesce(F.col("card_device_seen_before"), F.lit(0)) != 0
    return df.select("*", nc.alias("is_new_card"), nd.alias("is_new_device"), (~seen).alias("is_new_card_device_pair"),
                     (~nc).alias("card_history_available"), (~nd).alias("device_history_available"),
                     seen.alias("card_device_history_available"))


def rule_hits(p: RuleParams, model_score: Column | None = None) -> Column:
    """``array<struct<rule_id, severity, reason>>`` in the fixed rule order."""
    amount = F.coalesce(C.finite_or_null("TransactionAmt"), F.lit(0.0))
    v1 = F.coalesce(C.finite_or_null("card_txn_count_1h"), F.lit(0.0))
    v24 = F.coalesce(C.finite_or_null("card_txn_count_24h"), F.lit(0.0))
    cards = F.coalesce(C.finite_or_null("device_profile_unique_cards"), F.lit(0.0))
    ratio = C.finite_or_null("amount_vs_card_avg")
    new_card = F.coalesce(F.col("is_new_card").cast("boolean"), F.lit(False))
    new_dev = F.coalesce(F.col("is_new_device").cast("boolean"), F.lit(False))
    card_hist = F.coalesce(F.col("card_history_available").cast("boolean"), F.lit(False))
    both_new = new_card & new_dev
    hits = []
    if model_score is not None:
        s = C.finite_or_null(model_score)
        s4 = F.format_string("%.4f", s)
        hits.append(F.when(s >= p.high_risk_model_threshold, _hit("HIGH_MODEL_RISK", F.format_string(
            REASON_HIGH_MODEL, s4, F.lit(_num_text(p.high_risk_model_threshold))))))
        hits.append(F.when((s < p.high_risk_model_threshold) & (s >= p.medium_risk_model_threshold),
                           _hit("MEDIUM_MODEL_RISK", F.format_string(
                               REASON_MEDIUM_MODEL, s4, F.lit(_num_text(p.medium_risk_model_threshold))))))
    hits.append(F.when(both_new & (amount >= p.high_amount_threshold), _hit(
        "NEW_CARD_NEW_DEVICE_HIGH_AMOUNT", F.format_string(
            REASON_BOTH_NEW, F.format_string("%.2f", amount), F.lit("%.2f" % p.high_amount_threshold)))))
    hits.append(F.when(~both_new & new_card, _hit("NEW_CARD", F.lit(REASON_NEW_CARD))))
    hits.append(F.when(~both_new & new_dev, _hit("NEW_DEVICE", F.lit(REASON_NEW_DEVICE))))
    hits.append(F.when((v1 >= p.card_1h_velocity_threshold) | (v24 >= p.card_24h_velocity_threshold), _hit(
        "HIGH_CARD_VELOCITY", F.format_string(REASON_VELOCITY, _fmt_g(v1), _fmt_g(v24)))))
    hits.append(F.when(cards >= p.device_unique_card_threshold, _hit(
        "SHARED_DEVICE", F.format_string(REASON_SHARED, _fmt_g(cards), F.lit(_num_text(p.device_unique_card_threshold))))))
    hits.append(F.when(card_hist & (ratio >= p.unusual_amount_ratio_threshold),
                       _hit("UNUSUAL_AMOUNT", F.format_string(REASON_UNUSUAL, F.format_string("%.2f", ratio)))))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def score_level(rules: Column) -> tuple[Column, Column]:
    """Behaviour score and level from the severity mix."""
    n_high = F.size(F.filter(rules, lambda r: r["severity"] == "HIGH"))
    n_med = F.size(F.filter(rules, lambda r: r["severity"] == "MEDIUM"))
    conds = [n_high >= 2, n_high == 1, n_med >= 2, n_med == 1]
    score = level = None
    for cond, (sv, lv) in zip(conds, SCORE_TABLE[:4]):
        score = F.when(cond, F.lit(sv)) if score is None else score.when(cond, F.lit(sv))
        level = F.when(cond, F.lit(lv)) if level is None else level.when(cond, F.lit(lv))
    return score.otherwise(F.lit(SCORE_TABLE[4][0])), level.otherwise(F.lit(SCORE_TABLE[4][1]))


def evaluate(df: DataFrame, params: RuleParams | None = None, model_score: str | Column | None = None) -> DataFrame:
    """Adds ``rules_triggered``, ``behavioral_risk_score``, ``behavioral_risk_level``.

    Needs the cold-start columns (``is_new_card``, ``is_new_device``,
    ``card_history_available``) — from ``cold_start_from_features`` (R3) or
    from a history lookup (R1).  ``model_score`` is optional (trap 14).
    """
    p = params or RuleParams()
    ms = None if model_score is None else (F.col(model_score) if isinstance(model_score, str) else model_score)
    out = df.withColumn("rules_triggered", rule_hits(p, ms))
    score, level = score_level(F.col("rules_triggered"))
    return out.withColumn("behavioral_risk_score", score).withColumn("behavioral_risk_level", level)


def rule_ids(rules: str | Column = "rules_triggered") -> Column:
    """Comma-joined rule ids (flat form for reports)."""
    r = F.col(rules) if isinstance(rules, str) else rules
    return F.array_join(F.transform(r, lambda x: x["rule_id"]), ",")


def explode_hits(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per rule hit (with its position in the fixed order)."""
    return df.select(*keys, F.posexplode("rules_triggered").alias("rule_pos", "hit")).select(
        *keys, "rule_pos", "hit.rule_id", "hit.severity", "hit.reason")


def conservative_score(df: DataFrame) -> Column:
    """Continuous behaviour overlay from velocity, relative and absolute amount."""
    amount = F.coalesce(C.finite_or_null("TransactionAmt"), F.lit(0.0))
    ratio = F.coalesce(C.finite_or_null("amount_vs_card_avg"), F.lit(1.0))
    v1 = F.coalesce(C.finite_or_null("card_txn_count_1h"), F.lit(0.0))
    v24 = F.coalesce(C.finite_or_null("card_txn_count_24h"), F.lit(0.0))
    known = F.coalesce(F.col("new_card").cast("double"), F.lit(0.0)) == 0
    velocity = F.greatest(C.clip01(v1 / 3.0), C.clip01(v24 / 10.0))
    unusual = F.when(known, C.clip01((ratio - 1.5) / 2.5)).otherwise(F.lit(0.0))
    high = C.clip01((amount - 500.0) / 500.0)
    return C.clip01(F.lit(0.50) * velocity + F.lit(0.45) * unusual + F.lit(0.05) * high)
