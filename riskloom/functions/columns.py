"""Scalar column expressions: basic features, coercion, tiers, rounding.

All are plain ``pyspark.sql.functions`` compositions, so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw card and address columns.
CARD_COLUMNS = ["card1", "card2", "card3", "card4", "card5", "card6"]
ADDRESS_COLUMNS = ["addr1", "addr2"]

# Model feature order (21 features, in the reference's order).
MODEL_FEATURES = [
    "TransactionAmt", "TransactionAmt_log", "transaction_hour", "transaction_day",
    "has_identity", "missing_card_info", "missing_address", "missing_value_count",
    "card_transaction_count", "card_avg_amount", "amount_vs_card_avg", "new_card",
    "card_txn_count_1h", "card_txn_count_24h", "has_device_info", "device_profile_count",
    "device_profile_unique_cards", "new_device_profile", "card_device_transaction_count",
    "card_device_seen_before", "device_unique_cards_historical",
]
MISSING_DATA_FEATURES = ["missing_card_info", "missing_address", "missing_value_count"]


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Half-up rounding written so every engine gives the same double."""
    scale = float(10 ** digits)
    return F.floor(col(c) * scale + 0.5) / scale


# P1-P3 -----------------------------------------------------------------------
def amount_log(amt: str | Column = "TransactionAmt") -> Column:
    return F.log1p(col(amt))


def hour_of_day(dt: str | Column = "TransactionDT") -> Column:
    return F.pmod(F.floor(col(dt) / 3600), F.lit(24)).cast("int")


def day_index(dt: str | Column = "TransactionDT") -> Column:
    return F.floor(col(dt) / 86400).cast("long")


# P4-P6, P18 ------------------------------------------------------------------
def any_null(columns: Iterable[str]) -> Column:
    """1 if any of the columns is null, or if there is none of them (a record that lacks them all)."""
    cols = [F.col(c).isNull() for c in columns] or [F.lit(True)]
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out.cast("int")


def all_null(columns: Iterable[str]) -> Column:
    cols = [F.col(c).isNull() for c in columns]
    out = cols[0]
    for c in cols[1:]:
        out = out & c
    return out.cast("int")


def null_count(columns: Sequence[str]) -> Column:
    """Number of null columns in ``columns`` (one generated expression)."""
    if not columns:
        return F.lit(0)
    total = F.col(columns[0]).isNull().cast("int")
    for c in columns[1:]:
        total = total + F.col(c).isNull().cast("int")
    return total


def non_identity_columns(raw_columns: Sequence[str], identity_columns: Sequence[str]) -> list[str]:
    """Drop identity-only columns (keeping the join key) from a column list."""
    keep_key = {"TransactionID"}
    ident = set(identity_columns) - keep_key
    return [c for c in raw_columns if c not in ident]


# P8 ---------------------------------------------------------------------------
def model_ready(c: str | Column) -> Column:
    """Coerce to double (bad → null), ±inf/NaN → null, then null → 0."""
    x = F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.cast("double")
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


# S10 --------------------------------------------------------------------------
def json_safe(c: str | Column) -> Column:
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


# P12 ------------------------------------------------------------------------
def valid_id(raw: str | Column) -> Column:
    """Positive integer id, else null (try_cast keeps ANSI mode from raising)."""
    v = F.expr(f"try_cast(trim({raw}) as bigint)") if isinstance(raw, str) else raw.cast("bigint")
    return F.when(v > 0, v)


# P14 ---------------------------------------------------------------------------
def clip01(c: str | Column) -> Column:
    return F.least(F.greatest(col(c).cast("double"), F.lit(0.0)), F.lit(1.0))


# Three named tier policies (trap 12) ----------------------------
# Fixed values: (lower bound, level, decision) per policy, highest first.
TIER_POLICIES = {
    "model": [(0.90, "HIGH", "REVIEW"), (0.70, "MEDIUM", "REVIEW"), (None, "LOW", "APPROVE")],
    "simple": [(0.70, "HIGH", "REVIEW"), (0.30, "MEDIUM", "MONITOR"), (None, "LOW", "APPROVE")],
    "fused": [(0.80, "HIGH", None), (0.50, "MEDIUM", None), (None, "LOW", None)],
}


def tier(score: str | Column, policy: str = "model", what: str = "level") -> Column:
    idx = 1 if what == "level" else 2
    rows = TIER_POLICIES[policy]
    expr = None
    s = col(score)
    for bound, *vals in rows:
        v = F.lit(vals[idx - 1])
        if bound is None:
            expr = v if expr is None else expr.otherwise(v)
        else:
            expr = F.when(s >= bound, v) if expr is None else expr.when(s >= bound, v)
    return expr


# P13 -----------------------------------------------------------------------------
def completeness(n_fields: str | Column, synthetic: str | Column, min_fields: int = 20) -> Column:
    """PARTIAL if a record without a base row has fewer than ``min_fields`` fields (its flag counts as one)."""
    few = (col(n_fields) < min_fields) & ~col(synthetic).cast("boolean")
    return F.when(few, F.lit("PARTIAL")).otherwise(F.lit("COMPLETE"))


# NaN --------------------------------------------------------------------------------
def finite_or_null(c: str | Column) -> Column:
    """A number as double, NaN as null: NaN sorts above every number in Spark, so it must not meet a threshold."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x), x)
