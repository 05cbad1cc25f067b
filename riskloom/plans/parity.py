"""Batch vs point-in-time feature parity, per feature, with tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parity_report(a: DataFrame, b: DataFrame, features: Sequence[str], key: str = "TransactionID",
                  rtol: float = 1e-5, atol: float = 1e-8) -> DataFrame:
    """Join both feature tables on the key, unpivot and count mismatches
    (``|a-b| <= atol + rtol*|b|`` or both null counts as equal)."""
    j = a.select(key, *[F.col(f).cast("double").alias(f"a__{f}") for f in features]).join(
        b.select(key, *[F.col(f).cast("double").alias(f"b__{f}") for f in features]), on=key, how="inner")
    long = j.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a__{f}").alias("x"),
                                                 F.col(f"b__{f}").alias("y")) for f in features])).alias("r"))
    x, y = F.col("r.x"), F.col("r.y")
    same = (x.isNull() & y.isNull()) | (x.isNotNull() & y.isNotNull() & (F.abs(x - y) <= atol + rtol * F.abs(y)))
    return long.groupBy(F.col("r.feature").alias("feature")).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~same).alias("mismatches"))
