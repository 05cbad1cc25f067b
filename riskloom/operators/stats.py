"""Exact grouped quantiles without collecting a group into one task.

numpy/pandas-style linear interpolation: for N values and quantile q the
position h = (N-1)q sits between the floor(h)-th and ceil(h)-th smallest
values.  Both are found on the value histogram (one row per distinct value
and group) from "rows below" counts formed per value bucket plus bucket
offsets, so the work is a few aggregates and joins — never a sort of a whole
group, and never a driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNB = Window.unboundedPreceding
N_BUCKETS, MAX_BUCKETS = 256, 4096
ROWS_PER_BUCKET = 2_000_000
# Below this many distinct values per group, Spark's exact ``percentile``
# aggregate (a value→count map per group, merged in one task) has a proven
# memory bound; above it, the bucketed histogram plan is used.
DIRECT_DISTINCT_LIMIT = 1_000_000


def max_distinct(df: DataFrame, col: str, by: Sequence[str] = ()) -> int:
    """Approximate (rsd 5%) largest number of distinct values of ``col`` in a group."""
    g = df.groupBy(*by).agg(F.approx_count_distinct(col, 0.05).alias("_d")) if by else \
        df.agg(F.approx_count_distinct(col, 0.05).alias("_d"))
    r = g.agg(F.max("_d")).collect()[0][0]
    return int(r or 0)


def _qname(q: float) -> str:
    return "q" + format(q, "g").replace(".", "_").replace("-", "m")


def value_edges(df: DataFrame, col: str) -> list[float]:
    """Approximate quantiles that cut the rows into buckets of about ROWS_PER_BUCKET, N_BUCKETS to MAX_BUCKETS of them."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(
        F.col(col).cast("double"), [i / MAX_BUCKETS for i in range(1, MAX_BUCKETS)], 10_000).alias("q")).first()
    step = MAX_BUCKETS // min(MAX_BUCKETS, max(N_BUCKETS, 1 << (r["n"] // ROWS_PER_BUCKET).bit_length()))
    return sorted({q for q in (r["q"] or [])[step - 1::step] if q == q})


def in_buckets(df: DataFrame, col: str, edges: list[float], out: str) -> DataFrame:
    """The number of a value's bucket, by binary search in the JVM (missing values in a bucket of their own)."""
    x = F.col(col).cast("double")
    if not edges:
        return df.withColumn(out, F.when(x.isNull(), F.lit(1.0)).otherwise(F.lit(0.0)))
    from pyspark.ml.feature import Bucketizer
    cut = Bucketizer(splits=[-float("inf"), *edges, float("inf")], inputCol="_bx", outputCol=out, handleInvalid="keep")
    return cut.transform(df.withColumn("_bx", x)).drop("_bx")


def value_histogram(df: DataFrame, col: str, by: Sequence[str] = (), weight: str | None = None,
                    out: str = "v") -> DataFrame:
    """(by..., out, n, n_below): weight (default: rows) per distinct value and the
    weight of all smaller values in the group.  Values are bucketed by global
    approximate quantiles, so one large group is spread over up to N_BUCKETS
    tasks; only (group, bucket) totals cross buckets."""
    by = list(by)
    d = df.where(F.col(col).isNotNull())
    wexpr = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    hist = d.groupBy(*by, F.col(col).alias(out)).agg(wexpr.alias("n"))
    h = in_buckets(hist, out, value_edges(d, col), "_b")
    tot = h.groupBy(*by, "_b").agg(F.sum("n").alias("_t"))
    offs = tot.select(*by, "_b", F.coalesce(F.sum("_t").over(
        Window.partitionBy(*by).orderBy("_b").rowsBetween(UNB, -1)), F.lit(0)).alias("_o"))
    h = h.join(offs, on=[*by, "_b"], how="inner")
    local = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "_b").orderBy(out).rowsBetween(UNB, -1)), F.lit(0))
    return h.withColumn("n_below", F.col("_o") + local).drop("_b", "_o", "_t")


def quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with a column per quantile (names ``q0_25`` …) plus ``n``."""
    by = list(by)
    if max_distinct(df, col, by) * 1.2 <= DIRECT_DISTINCT_LIMIT:
        d = df.where(F.col(col).isNotNull())
        # one call for all quantiles: one value map
        aggs = [F.count(F.lit(1)).alias("n"),
                F.percentile(F.col(col).cast("double"), F.array(*[F.lit(float(q)) for q in qs])).alias("_q")]
        out = d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)
        return out.select(*by, "n", *[F.get("_q", F.lit(i)).alias(_qname(q)) for i, q in enumerate(qs)])
    h = value_histogram(df.withColumn("_qv", F.col(col).cast("double")), "_qv", by)
    if not by:
        h, by_ = h.withColumn("_all", F.lit(1)), ["_all"]
    else:
        by_ = by
    tot = h.groupBy(*by_).agg(F.sum("n").alias("_N"))
    h = h.join(tot, on=by_, how="inner")
    aggs = [F.first("_N").alias("n")]
    for q in qs:
        pos = (F.col("_N") - 1) * F.lit(float(q))
        i0, i1 = F.floor(pos), F.ceil(pos)
        has0 = (F.col("n_below") <= i0) & (i0 < F.col("n_below") + F.col("n"))
        has1 = (F.col("n_below") <= i1) & (i1 < F.col("n_below") + F.col("n"))
        nm = _qname(q)
        aggs += [F.max(F.when(has0, F.col("v"))).alias(f"_{nm}_lo"), F.max(F.when(has1, F.col("v"))).alias(f"_{nm}_hi"),
                 F.first(pos - i0).alias(f"_{nm}_up"), F.first(i1 - pos).alias(f"_{nm}_down")]
    g = h.groupBy(*by_).agg(*aggs)
    cols = [c for c in by] + ["n"]
    out = [F.col(c) for c in cols]
    for q in qs:
        nm = _qname(q)
        lo, hi, up, down = (F.col(f"_{nm}_{x}") for x in ("lo", "hi", "up", "down"))
        # the arithmetic of ``percentile``, so both ways give the same double
        out.append(F.when(up == 0, lo).otherwise(down * lo + up * hi).alias(nm))
    return g.select(*out)


def quantile_name(q: float) -> str:
    return _qname(q)
