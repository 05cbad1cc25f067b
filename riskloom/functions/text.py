"""Report text checks (G1-G3, G5) as column expressions over a table of reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases a report may not contain (case-insensitive) and the
# patterns of exposed secrets.
FORBIDDEN_PHRASES = ["definitely fraudulent", "certainly fraudulent", "100% fraud", "confirmed fraud",
                     "guaranteed fraud"]
SECRET_PATTERNS = [r"gsk_[A-Za-z0-9_-]+", r"sk-[A-Za-z0-9_-]+"]
# Analyst feedback labels accepted by the feedback sink.
FEEDBACK_LABELS = ["CONFIRMED_FRAUD", "FALSE_POSITIVE", "LEGITIMATE", "NEEDS_MORE_INFORMATION"]
# Violation names in check order.
VIOLATIONS = ["missing_report", "unsupported_claim", "score_mismatch", "level_mismatch", "decision_mismatch", "secret_exposure"]


def has_forbidden(text: Column, phrases: Sequence[str] = FORBIDDEN_PHRASES) -> Column:
    """G1: any phrase contained in lower(text)."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(p.lower()) for p in phrases]), lambda p: F.contains(low, p))


def has_secret(text: Column, patterns: Sequence[str] = SECRET_PATTERNS) -> Column:
    """Any pattern found anywhere in the text."""
    out = None
    for p in patterns:
        c = text.rlike(p)
        out = c if out is None else (out | c)
    return out


def first_violation(text: Column, score: Column, level: Column, decision: Column,
                    phrases: Sequence[str] = FORBIDDEN_PHRASES, patterns: Sequence[str] = SECRET_PATTERNS) -> Column:
    """G1 → G2 (score, level, decision: case-sensitive substrings) → G3, first failure wins.

    Fails closed: a null report is a violation of its own, and an expected value that is null is not in any report.
    """
    lacks = lambda part: ~F.coalesce(F.contains(text, part), F.lit(False))
    return (F.when(text.isNull(), F.lit(VIOLATIONS[0]))
            .when(has_forbidden(text, phrases), F.lit(VIOLATIONS[1]))
            .when(lacks(score), F.lit(VIOLATIONS[2]))
            .when(lacks(level), F.lit(VIOLATIONS[3]))
            .when(lacks(decision), F.lit(VIOLATIONS[4]))
            .when(has_secret(text, patterns), F.lit(VIOLATIONS[5])))


def validate_reports(reports: DataFrame, id_cols: Sequence[str], text: str = "report", score: str = "risk_score",
                     level: str = "risk_level", decision: str = "decision",
                     phrases: Sequence[str] = FORBIDDEN_PHRASES, patterns: Sequence[str] = SECRET_PATTERNS) -> DataFrame:
    """Table form of the output guardrail: (ids, passed, first_violation) — no exception per row."""
    v = first_violation(F.col(text), F.col(score).cast("string"), F.col(level), F.col(decision), phrases, patterns)
    return reports.select(*id_cols, v.isNull().alias("passed"), v.alias("first_violation"))


def valid_feedback(label: Column, allowed: Sequence[str] = FEEDBACK_LABELS) -> Column:
    """G5."""
    return label.isin(list(allowed))
