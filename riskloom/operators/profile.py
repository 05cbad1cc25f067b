"""Data profiling (A3-A20, U1, U2): one aggregate per question, exact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import stats as S


def label_frequency(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """A3 + A4: rows per label and percentage of all rows."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    tot = df.agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    return (g.withColumn("_k", F.lit(1)).join(tot, "_k").drop("_k")
            .withColumn("percent", F.col("rows") * 100.0 / F.col("_n")).drop("_n"))


def fraud_rate(df: DataFrame, label: str = "isFraud") -> DataFrame:
    """A4."""
    return df.agg((F.avg(F.col(label).cast("double")) * 100).alias("fraud_rate_pct"))


def null_shares(df: DataFrame, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """Null count and share per column in ONE aggregate, unpivoted, largest first."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"n__{c}") for c in columns])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n__{c}").alias("nulls"))
                                for c in columns]))
    long = wide.select("_n", stack.alias("s")).select(
        "s.column_name", "s.nulls", (F.col("s.nulls") * 100.0 / F.col("_n")).alias("null_percent"))
    long = long.orderBy(F.desc("nulls"), "column_name")
    return long.limit(top) if top else long


def id_coverage(txns: DataFrame, identity: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Distinct ids per table and share of identity ids present in transactions."""
    t = txns.select(key).distinct().withColumn("_in_t", F.lit(1))
    i = identity.select(key).distinct()
    j = i.join(t, on=key, how="left")
    cov = j.agg(F.count(F.lit(1)).alias("identity_ids"),
                (F.avg(F.coalesce(F.col("_in_t"), F.lit(0)).cast("double")) * 100).alias("found_percent"))
    n_t = t.agg(F.count(F.lit(1)).alias("transaction_ids"))
    return cov.withColumn("_k", F.lit(1)).join(n_t.withColumn("_k", F.lit(1)), on="_k").drop("_k")


def describe_by(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles (exact, linear), max per group."""
    by = list(by)
    base = df.groupBy(*by).agg(F.count(col).alias("count"), F.avg(col).alias("mean"),
                               F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"))
    q = S.quantiles(df, col, [0.25, 0.5, 0.75], by).drop("n")
    return base.join(q, on=by, how="left").withColumnRenamed("q0_25", "p25") \
        .withColumnRenamed("q0_5", "median").withColumnRenamed("q0_75", "p75")


def means_by(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """A11."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def rate_by_quantile_bin(df: DataFrame, col: str, label: str = "isFraud", n_bins: int = 10) -> DataFrame:
    """Label rate per quantile bin of ``col``; duplicate edges dropped, bins
    right-closed with the lowest edge included (ties never split)."""
    qs = [i / n_bins for i in range(n_bins + 1)]
    edges = S.quantiles(df, col, qs).drop("n")
    names = [S.quantile_name(q) for q in qs]
    d = df.where(F.col(col).isNotNull()).withColumn("_k", F.lit(1)).join(
            F.broadcast(edges.withColumn("_k", F.lit(1))), on="_k").drop("_k")   # one-row table
    uniq = F.array_distinct(F.array(*[F.col(n) for n in names]))
    inner = F.slice(uniq, 2, F.size(uniq) - 2)
    # bin = 1 + number of distinct inner edges strictly below the value
    b = F.lit(1) + F.size(F.filter(inner, lambda e: e < F.col(col)))
    d = d.withColumn("bin", b).withColumn("_edges", uniq)
    return d.groupBy("bin").agg(
        F.first(F.element_at("_edges", F.col("bin"))).alias("lower"),
        F.first(F.element_at("_edges", F.col("bin") + 1)).alias("upper"),
        F.count(F.lit(1)).alias("rows"), F.avg(F.col(label).cast("double")).alias("rate"))


def crosstab_share(df: DataFrame, row: str, col: str) -> DataFrame:
    """A13 (long form): count per (row, col) and its share of the row total."""
    c = df.groupBy(row, col).agg(F.count(F.lit(1)).alias("rows"))
    t = df.groupBy(row).agg(F.count(F.lit(1)).alias("_t"))
    return c.join(t, on=row).withColumn("share", F.col("rows") / F.col("_t")).drop("_t")


def crosstab_wide(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """A13 (pivoted) with the column values given (no extra distinct job)."""
    p = df.groupBy(row).pivot(col, list(values)).count().fillna(0)
    tot = sum(F.col(str(v)) for v in values)
    return p.select(row, *[(F.col(str(v)) / tot).alias(str(v)) for v in values])


def split_summary(df: DataFrame, split: str = "split", label: str = "isFraud", dt: str = "TransactionDT") -> DataFrame:
    """A15 + A16."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("frauds"),
                                 (F.avg(F.col(label).cast("double")) * 100).alias("fraud_percent"),
                                 F.min(dt).alias("min_dt"), F.max(dt).alias("max_dt"))


def velocity_summary(df: DataFrame, cols: Sequence[str] = ("card_txn_count_1h", "card_txn_count_24h")) -> DataFrame:
    """A18 + A19: invariant 24h >= 1h, and count / mean / std / min / quartiles / max / non-zero per column."""
    aggs = [F.bool_and(F.col(cols[1]) >= F.col(cols[0])).alias("invariant_24h_ge_1h")]
    for c in cols:
        aggs += [F.count(c).alias(f"{c}_count"), F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.count_if(F.col(c) > 0).alias(f"{c}_nonzero"),
                 F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}")]
    quartiles = [F.get(f"_q_{c}", F.lit(i)).alias(f"{c}_q{q}") for c in cols for i, q in enumerate((25, 50, 75))]
    out = df.agg(*aggs)
    return out.select(*[c for c in out.columns if not c.startswith("_q_")], *quartiles)


def device_summary(df: DataFrame, dev: str = "DeviceInfo") -> DataFrame:
    """Distinct devices and share of rows without one."""
    return df.agg(F.countDistinct(dev).alias("distinct_devices"),
                  (F.avg(F.col(dev).isNull().cast("double")) * 100).alias("missing_device_percent"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """U1."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def key_uniqueness(df: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Rows, distinct keys and duplicated keys."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    return per.agg(F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
                   F.count_if(F.col("_c") > 1).alias("duplicated_keys"))


# ---------------------------------------------------------------------------
# T7-T10, P16, P17, J5
# ---------------------------------------------------------------------------
def best_threshold(sweep: DataFrame, metric: str = "f1", threshold: str = "threshold") -> DataFrame:
    """Row with the best ``metric``; the lowest threshold wins ties (one aggregate)."""
    best = F.max_by(F.struct(*sweep.columns), F.struct(F.col(metric), -F.col(threshold)))
    return sweep.agg(best.alias("b")).select("b.*")


def highest(df: DataFrame, score: str, tiebreak: Sequence[str] = ("TransactionDT", "TransactionID")) -> DataFrame:
    """The row with the highest score (earliest on ties) — an aggregate, no sort."""
    rank = F.struct(F.col(score), *[-F.col(c) for c in tiebreak])
    return df.agg(F.max_by(F.struct(*df.columns), rank).alias("r")).select("r.*")


def extremes(df: DataFrame, n: int = 5, order: Sequence[str] = ("TransactionDT", "TransactionID")) -> DataFrame:
    """The n earliest and n latest rows (bounded top-n, no global sort)."""
    first = df.orderBy(*order).limit(n).withColumn("end", F.lit("earliest"))
    last = df.orderBy(*[F.desc(c) for c in order]).limit(n).withColumn("end", F.lit("latest"))
    return first.unionByName(last)


def seeded_sample(df: DataFrame, n: int = 5000, seed: int = 42, key: str = "TransactionID") -> DataFrame:
    """Deterministic sample of at most n rows (order of an md5 of seed and id, independent of partitioning)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def fill_device(txns: DataFrame, identity: DataFrame, key: str = "TransactionID", dev: str = "DeviceInfo") -> DataFrame:
    """Take the identity device only where the transaction has none."""
    from riskloom.operators.features import keep_first
    ident = keep_first(identity.select(key, dev), key, [dev]).withColumnRenamed(dev, "_idev")
    j = txns.join(ident, on=key, how="left")
    return j.withColumn(dev, F.coalesce(F.col(dev), F.col("_idev"))).drop("_idev")


def drop_if_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P17."""
    return df.drop(*[c for c in columns if c in df.columns])


def keep_known(store: DataFrame, history: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Store rows whose id occurs in the history (left semi join)."""
    return store.join(history.select(key), on=key, how="left_semi")
