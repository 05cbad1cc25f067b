"""Bind the domain tables (transactions, identity, scores) to the test data.

The transaction domain has no table of its own in the shared test data, so
it is a projection of ``events`` (and of ``orders`` for same-second ties).
Each binding exists twice: as a DataFrame plan and as a SQL text of the same
meaning for the independent oracle.  Both must stay in step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the binding (FIXTURES.md §3).
ORIGIN_EPOCH = 1704067200          # 2024-01-01T00:00:00Z, origin of TransactionDT
CARD3, CARD4, CARD5, CARD6 = 150.0, "visa", 226.0, "debit"
ADDR1, ADDR2 = 315.0, 87.0
FRAUD_EVENT = "error"

TXN_COLUMNS = [
    "TransactionID", "TransactionDT", "TransactionAmt", "card1", "card2", "card3",
    "card4", "card5", "card6", "addr1", "addr2", "isFraud",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _k() -> Column:
    return F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")


def _epoch_seconds(ts: str) -> Column:
    return F.expr(f"unix_micros(cast({ts} as timestamp)) div 1000000")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → transactions (11 used columns + label)."""
    return as_transactions(table(spark, sf_dir, "events"))


def as_transactions(e: DataFrame) -> DataFrame:
    """The binding alone, for a table or a stream of events."""
    eid = F.col("event_id")
    return e.select(
        eid.alias("TransactionID"),
        (_epoch_seconds("ts") - F.lit(ORIGIN_EPOCH)).alias("TransactionDT"),
        F.col("value").cast("double").alias("TransactionAmt"),
        F.col("user_id").alias("card1"),
        F.when(eid % 7 == 0, F.lit(None).cast("double")).otherwise((eid % 5).cast("double")).alias("card2"),
        F.lit(CARD3).alias("card3"),
        F.lit(CARD4).alias("card4"),
        F.lit(CARD5).alias("card5"),
        F.lit(CARD6).alias("card6"),
        F.when(eid % 11 == 0, F.lit(None).cast("double")).otherwise(F.lit(ADDR1)).alias("addr1"),
        F.when(eid % 13 == 0, F.lit(None).cast("double")).otherwise(F.lit(ADDR2)).alias("addr2"),
        (F.col("event_type") == FRAUD_EVENT).cast("int").alias("isFraud"),
    )


def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events → identity: one row when k % 4 <> 0; device null when k % 5 = 0."""
    e = table(spark, sf_dir, "events").select("event_id", _k().alias("k"))
    return e.where(F.col("k") % 4 != 0).select(
        F.col("event_id").alias("TransactionID"),
        F.when(F.col("k") % 5 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("dev-"), (F.col("k") % 20).cast("string")))
        .alias("DeviceInfo"),
    )


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders → transactions with same-second ties (day resolution)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("TransactionID"),
        _epoch_seconds("o_orderdate").alias("TransactionDT"),
        F.col("o_totalprice").cast("double").alias("TransactionAmt"),
        F.col("o_custkey").alias("card1"),
        F.col("o_orderpriority").alias("DeviceInfo"),
        (F.col("o_orderstatus") == "P").cast("int").alias("isFraud"),
    )


def score_expr(amt: Column, dt: Column) -> Column:
    """Fixed logistic of log-amount and hour, rounded half-up to 2 dp (ties occur)."""
    hour = F.pmod(F.floor(dt / 3600), F.lit(24))
    z = F.log1p(amt) - F.lit(3.5) + F.lit(0.05) * hour
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return F.floor(p * 100 + 0.5) / 100


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(TransactionID, TransactionDT, y, score) — input of the metric operators."""
    t = transactions(spark, sf_dir)
    return t.select(
        "TransactionID", "TransactionDT",
        F.col("isFraud").alias("y"),
        score_expr(F.col("TransactionAmt"), F.col("TransactionDT")).alias("score"),
    )


# ---------------------------------------------------------------------------
# The same bindings as SQL (DuckDB dialect), used by the oracle queries.
# ---------------------------------------------------------------------------
SQL_TX = f"""
tx AS (
  SELECT event_id AS TransactionID,
         epoch_us(ts) // 1000000 - {ORIGIN_EPOCH} AS TransactionDT,
         CAST(value AS DOUBLE) AS TransactionAmt,
         user_id AS card1,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 5 AS DOUBLE) END AS card2,
         CAST({CARD3} AS DOUBLE) AS card3, '{CARD4}' AS card4,
         CAST({CARD5} AS DOUBLE) AS card5, '{CARD6}' AS card6,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST({ADDR1} AS DOUBLE) END AS addr1,
         CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST({ADDR2} AS DOUBLE) END AS addr2,
         CAST(event_type = '{FRAUD_EVENT}' AS INTEGER) AS isFraud
  FROM events)"""

SQL_ID = """
ev_k AS (
  SELECT event_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events),
idt AS (
  SELECT event_id AS TransactionID,
         CASE WHEN k % 5 = 0 THEN NULL ELSE 'dev-' || CAST(k % 20 AS VARCHAR) END AS DeviceInfo
  FROM ev_k WHERE k % 4 <> 0)"""

SQL_ORDERS_TX = """
otx AS (
  SELECT o_orderkey AS TransactionID, epoch_us(o_orderdate) // 1000000 AS TransactionDT,
         CAST(o_totalprice AS DOUBLE) AS TransactionAmt, o_custkey AS card1,
         o_orderpriority AS DeviceInfo, CAST(o_orderstatus = 'P' AS INTEGER) AS isFraud
  FROM orders)"""

SQL_SCORED = """
sc AS (
  SELECT TransactionID, TransactionDT, isFraud AS y,
         floor(1.0 / (1.0 + exp(-(ln(1 + TransactionAmt) - 3.5
               + 0.05 * ((TransactionDT // 3600) % 24)))) * 100 + 0.5) / 100 AS score
  FROM tx)"""


def with_sql(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)
