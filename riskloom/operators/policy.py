"""Fusion, calibration application and decisions (D6-D14) as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C


@dataclass(frozen=True)
class FusionConfig:
    """D11 parameters; weights are normalised, disabled fusion means model only."""
    model_weight: float = 0.80
    behavioral_weight: float = 0.20
    review_threshold: float = 0.50
    high_threshold: float = 0.80
    enabled: bool = True

    def normalised(self) -> tuple[float, float]:
        if not self.enabled:
            return 1.0, 0.0
        total = self.model_weight + self.behavioral_weight
        if total <= 0:
            return 1.0, 0.0
        return self.model_weight / total, self.behavioral_weight / total


def fuse(df: DataFrame, cfg: FusionConfig, model_col: str = "calibrated_model_score",
         behaviour_col: str = "behavioral_risk_score") -> DataFrame:
    """Clipped weighted sum, level (high/review thresholds) and decision."""
    wm, wb = cfg.normalised()
    final = C.clip01(F.lit(wm) * C.clip01(model_col) + F.lit(wb) * C.clip01(behaviour_col))
    level = (F.when(final >= cfg.high_threshold, "HIGH").when(final >= cfg.review_threshold, "MEDIUM")
             .otherwise("LOW"))
    decision = F.when(final >= cfg.review_threshold, "REVIEW").otherwise("APPROVE")
    return df.withColumn("final_risk_score", final).withColumn("final_risk_level", level) \
             .withColumn("fusion_decision", decision)


def decide(final_score: Column | None, model_score: Column, behavioural_level: Column,
           review_threshold: float = 0.50) -> Column:
    """Fused score wins when present; legacy path otherwise."""
    legacy = (F.when(model_score >= review_threshold, "REVIEW")
              .when(behavioural_level.isin("HIGH", "MEDIUM"), "REVIEW").otherwise("APPROVE"))
    if final_score is None:
        return legacy
    return F.when(final_score.isNotNull(),
                  F.when(final_score >= review_threshold, "REVIEW").otherwise("APPROVE")).otherwise(legacy)


def fail_closed(decision: Column) -> Column:
    """A row whose scoring failed (null decision) goes to review."""
    return F.coalesce(decision, F.lit("REVIEW"))


def assessment(id_col: str, score_col: str, evidence_col: str | None = None, policy: str = "simple") -> Column:
    """Assessment record struct (id, score, level, decision, evidence)."""
    fields = [F.col(id_col).alias("transaction_id"), F.col(score_col).alias("risk_score"),
              C.tier(score_col, policy, "level").alias("risk_level"),
              C.tier(score_col, policy, "decision").alias("decision")]
    if evidence_col:
        fields.append(F.col(evidence_col).alias("evidence"))
    return F.struct(*fields)
