"""Per-transaction investigation records.

The reference scores one transaction per request (12 scorings each, with a
full-table scan per question).  Here one plan answers a whole table of
requests: validate ids → join the stored row or overlay the payload → point-
in-time lookup → cold start → rules → fusion → decision → one nested struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import features as FE
from riskloom.operators import history as H
from riskloom.operators import policy as PO
from riskloom.operators import rules as R

TXN_FIELDS = ["TransactionID", "TransactionDT", "TransactionAmt", "card1", "DeviceInfo"]


def split_ids(requests: DataFrame, raw_col: str = "raw_id") -> tuple[DataFrame, DataFrame]:
    """(accepted with ``TransactionID``, rejected with a reason)."""
    v = C.valid_id(raw_col)
    tagged = requests.withColumn("TransactionID", v)
    good = tagged.where(F.col("TransactionID").isNotNull())
    bad = tagged.where(F.col("TransactionID").isNull()).withColumn(
        "reason", F.when(F.expr(f"try_cast(trim({raw_col}) as bigint)").isNull(), F.lit("not_an_integer"))
        .otherwise(F.lit("not_positive")))
    return good, bad


def transaction_view(txns: DataFrame) -> DataFrame:
    """The five-field projection used by investigations."""
    return txns.select(*TXN_FIELDS)


COLD_START = ("is_new_card", "is_new_device", "is_new_card_device_pair", "card_history_available",
              "device_history_available")


def investigate(probes: DataFrame, history: DataFrame, params: R.RuleParams | None = None,
                fusion: PO.FusionConfig | None = None, model_score: str | None = None,
                review_threshold: float = 0.50, evidence: str | None = None,
                completeness: str | None = None) -> DataFrame:
    """One record per probe.

    ``model_score``, ``evidence`` (array, strongest first; five are kept) and
    ``completeness`` name probe columns and are optional: without a score the
    rules decide, without a completeness a record counts as COMPLETE.
    """
    feats = H.cold_start(H.lookup(probes, history))
    ms = C.finite_or_null(model_score) if model_score else F.lit(None).cast("double")
    r = R.evaluate(feats.withColumn("_ms", ms), params, "_ms" if model_score else None)
    cfg = fusion or PO.FusionConfig()
    r = PO.fuse(r.withColumn("calibrated_model_score", F.coalesce(F.col("_ms"), F.lit(0.0))), cfg)
    scored = F.col("_ms").isNotNull()
    decision = PO.decide(F.when(scored, F.col("final_risk_score")), F.coalesce(F.col("_ms"), F.lit(0.0)),
                         F.col("behavioral_risk_level"), review_threshold)
    if model_score:                 # a score was asked for and failed: no decision, so the row goes to review
        decision = F.when(scored, decision)
    r = r.join(H.card_profile(probes, history).dropDuplicates(["TransactionID"]), "TransactionID", "left")
    dev_known = F.col("DeviceInfo").isNotNull() & F.col("TransactionDT").isNotNull()
    none = F.lit(None).cast("string")
    record = F.struct(
        F.col("TransactionID").alias("transaction_id"),
        F.struct(*[F.col(c) for c in TXN_FIELDS]).alias("transaction"),
        F.struct(F.col("_ms").alias("model_score"), F.when(scored, C.tier("_ms", "model", "level")).alias("model_level"),
                 F.when(scored, C.tier("_ms", "model", "decision")).alias("model_decision")).alias("risk"),
        F.struct(F.col("behavioral_risk_score").alias("score"), F.col("behavioral_risk_level").alias("level"),
                 F.col("rules_triggered")).alias("behavioral_risk"),
        F.struct("calibrated_model_score", "final_risk_score", "final_risk_level", "fusion_decision").alias("risk_fusion"),
        PO.fail_closed(decision).alias("final_decision"),
        F.struct(*COLD_START).alias("cold_start"),
        (F.col(completeness) if completeness else F.lit("COMPLETE")).alias("input_completeness"),
        (F.slice(F.col(evidence), 1, 5) if evidence else F.array().cast("array<string>")).alias("evidence"),
        F.struct("card1", F.col("card_history_count").alias("transaction_count"),
                 F.col("card_history_mean").alias("average_amount"), F.col("card_history_max").alias("max_amount"),
                 F.col("card_history_min").alias("min_amount")).alias("card_history"),
        F.struct(F.when(dev_known, F.col("DeviceInfo")).otherwise(none).alias("device_info"),
                 F.when(dev_known, F.col("device_profile_count")).otherwise(0).alias("transaction_count"),
                 F.when(dev_known, F.col("device_profile_unique_cards")).otherwise(0).alias("unique_cards"))
        .alias("device_history"))
    return r.select("TransactionID", record.alias("investigation"))


def flat_record(records: DataFrame, col: str = "investigation") -> DataFrame:
    """One plain column per scalar of the record, the rule ids joined (the tabular form of D18)."""
    i = lambda name: F.col(f"{col}.{name}")
    return records.select(
        "TransactionID", i("risk.model_score").alias("model_score"), i("risk.model_level").alias("model_level"),
        i("risk.model_decision").alias("model_decision"), i("behavioral_risk.score").alias("behavioral_score"),
        i("behavioral_risk.level").alias("behavioral_level"), R.rule_ids(i("behavioral_risk.rules_triggered")).alias("rule_ids"),
        i("risk_fusion.final_risk_score").alias("final_risk_score"), i("risk_fusion.final_risk_level").alias("final_risk_level"),
        i("final_decision").alias("final_decision"), *[i(f"cold_start.{c}").alias(c) for c in COLD_START],
        i("input_completeness").alias("input_completeness"),
        F.to_json(i("evidence")).alias("evidence"),
        *[i(f"card_history.{c}").alias(f"card_{c}") for c in ("transaction_count", "average_amount", "max_amount", "min_amount")],
        i("device_history.device_info").alias("device_info"), i("device_history.transaction_count").alias("device_transaction_count"),
        i("device_history.unique_cards").alias("device_unique_cards"))


def to_json_context(records: DataFrame, col: str = "investigation") -> DataFrame:
    """Record → JSON text (the context handed to a report writer)."""
    return records.select("TransactionID", F.to_json(F.col(col)).alias("context_json"))


def payload_requests(payloads: DataFrame, base: DataFrame, fields: Sequence[str] = TXN_FIELDS) -> DataFrame:
    """J14 + P13: overlay payloads on matched base rows; completeness from the size of the record."""
    o = H.overlay_payload(payloads, base, fields)
    return o.withColumn("completeness", C.completeness(F.col("_fields"), "synthetic")).drop("_fields")


def find_stored(requests: DataFrame, stored: DataFrame, id_col: str = "TransactionID") -> DataFrame:
    """P10: many ids against the stored rows; ``found`` is false where there is none (the row's columns are null).

    Stored rows that nobody asked for are left out at the scan (few ids) or by
    a semi join.  Of rows that repeat an id the earliest is found, ties going
    to the smallest values of the other columns.
    """
    asked, _ = H.wanted_keys(requests.select(id_col))
    rows = stored.join(asked, id_col, "left_semi").withColumn("found", F.lit(True))
    order = sorted((c for c in rows.columns if c != id_col), key=lambda c: c != "TransactionDT")
    rows = FE.keep_first(rows, id_col, order)
    return requests.join(rows, id_col, "left").withColumn("found", F.coalesce("found", F.lit(False)))
