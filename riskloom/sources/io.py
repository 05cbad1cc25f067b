"""Readers, writers and contract checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions import columns as C

# Pinned types of the used columns (the wider type where the reference narrows).
TRANSACTION_SCHEMA = T.StructType([
    T.StructField("TransactionID", T.LongType()), T.StructField("isFraud", T.IntegerType()),
    T.StructField("TransactionDT", T.LongType()), T.StructField("TransactionAmt", T.DoubleType()),
    T.StructField("card1", T.LongType()), T.StructField("card2", T.DoubleType()),
    T.StructField("card3", T.DoubleType()), T.StructField("card4", T.StringType()),
    T.StructField("card5", T.DoubleType()), T.StructField("card6", T.StringType()),
    T.StructField("addr1", T.DoubleType()), T.StructField("addr2", T.DoubleType()),
])
IDENTITY_SCHEMA = T.StructType([T.StructField("TransactionID", T.LongType()),
                                T.StructField("DeviceInfo", T.StringType())])
FEEDBACK_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.LongType()), T.StructField("analyst_label", T.StringType()),
    T.StructField("analyst_comment", T.StringType()), T.StructField("model_score", T.DoubleType()),
    T.StructField("behavioral_score", T.DoubleType()), T.StructField("final_decision", T.StringType()),
    T.StructField("model_version", T.StringType()), T.StructField("timestamp", T.TimestampType()),
])


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the CSV header only (schema of the first line)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV read with the used columns and pinned types (column pruning by select).

    Columns are matched by name: the file is read as strings, then the
    listed columns are cast (bad values → null, ANSI-safe)."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} is missing required columns: {missing}")
    return nan_to_null(raw.select(*[F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})").alias(f.name)
                                    for f in schema]))


def parse_lines(lines: DataFrame, header: Sequence[str], schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """S1/S3 on raw CSV lines (one string column): (typed rows, rejected lines).

    ``header`` names the fields of a line, in order; the columns of ``schema``
    come back.  A line is rejected, and kept whole as ``line``, if a listed
    value is not of its type or if it has too few or too many fields.  Empty
    values are null, empty lines are no rows; every other line is in one of the
    two frames.  No quoted line breaks.
    """
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    bad = "_corrupt_record"
    while bad in header:
        bad += "_"
    types = {f.name: f.dataType.simpleString() for f in schema}
    ddl = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in [*header, bad])
    line = F.col(lines.columns[0])
    parsed = lines.where(F.length(line) > 0).select(line.alias("line"), F.from_csv(
        line, ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("_r"))
    is_bad = F.col("_r").getField(bad).isNotNull()
    good = parsed.where(~is_bad).select(*[F.col("_r").getField(f.name).alias(f.name) for f in schema])
    return nan_to_null(good), parsed.where(is_bad).select("line")


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejected lines) of header CSV files that share their header line."""
    lines = spark.read.text(path)
    first = lines.first()
    head = first["value"] if first else ""
    return parse_lines(lines.where(F.col("value") != head), header_columns(spark, path), schema)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating columns with NaN as null, as every later comparison expects."""
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def read_labels(df: DataFrame, key: str = "TransactionID", label: str = "isFraud") -> DataFrame:
    """S4."""
    return df.select(key, label)


def read_table_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty typed table if the path does not exist; other errors are raised."""
    try:
        return nan_to_null(spark.read.schema(schema).parquet(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_assessments(spark: SparkSession, path: str) -> DataFrame:
    """JSON object keyed by transaction id → one row per id (int keys)."""
    raw = spark.read.option("multiLine", True).text(path, wholetext=True)
    m = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    return raw.select(F.explode(m).alias("k", "assessment")).select(
        F.expr("try_cast(k as bigint)").alias("TransactionID"), "assessment")


def write_table(df: DataFrame, path: str, order: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet; a time-ordered table is range-partitioned on the order
    keys so that files hold disjoint time ranges (row-group skipping on time)."""
    out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    out.write.mode(mode).parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Long metric reports, non-finite values as null."""
    out = df.withColumn("value", C.json_safe("value")) if "value" in df.columns else df
    out.coalesce(1).write.mode("overwrite").format(fmt).option("header", True).save(path)


def validate_feedback(raw: DataFrame, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted with a UTC timestamp, rejected)."""
    ok = F.col("analyst_label").isin(list(allowed))
    acc = raw.where(ok).withColumn("timestamp", F.current_timestamp())
    return acc, raw.where(~ok | F.col("analyst_label").isNull())


def append_feedback(df: DataFrame, path: str) -> None:
    """Append-only sink (no read-modify-write)."""
    df.write.mode("append").parquet(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Older rows lack some columns: merge schemas on read."""
    return spark.read.option("mergeSchema", True).parquet(path)


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> None:
    """Driver-side contract check on the schema (no data read)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: " + ", ".join(missing))


def unique_key_report(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys, duplicated keys (one aggregate)."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    return per.agg(F.sum("_c").alias("rows"), F.count(F.lit(1)).alias("distinct_keys"),
                   F.count_if(F.col("_c") > 1).alias("duplicated_keys"))


def labelled_join(features: DataFrame, labels: DataFrame, key: str = "TransactionID",
                  label: str = "isFraud", how: str = "left") -> tuple[DataFrame, DataFrame]:
    """1:1 feature×label join plus its contract report
    (duplicates on either side, unlabelled rows).

    The report reads the keys of both sides once, adds them up per key before
    the only shuffle, and needs no join.  ``how`` is left or inner.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be left or inner, not {how}")
    features = features.drop(label) if label in features.columns else features    # the label table wins
    j = features.join(labels.select(key, label), on=key, how=how)
    one, no = F.lit(1).cast("long"), F.lit(0).cast("long")
    sides = features.select(key, one.alias("f"), no.alias("l"), no.alias("n")).unionAll(
        labels.select(key, no, one, F.col(label).isNull().cast("long")))
    per = sides.groupBy(key).agg(F.sum("f").alias("f"), F.sum("l").alias("l"), F.sum("n").alias("n"))
    met = F.when(F.col(key).isNotNull(), F.col("l")).otherwise(no)      # a null key meets no label
    alone = (met == 0) & F.lit(how == "left")
    return j, per.agg(
        F.coalesce(F.sum(F.col("f") * F.when(alone, one).otherwise(met)), no).alias("rows"),
        F.coalesce(F.sum(F.col("f") * F.when(alone, one).when(met > 0, F.col("n")).otherwise(no)), no).alias("unlabelled"),
        F.count_if(F.col("f") > 1).alias("feature_dupes"), F.count_if(F.col("l") > 1).alias("label_dupes"))


def write_labelled(features: DataFrame, labels: DataFrame, path: str, key: str = "TransactionID",
                   label: str = "isFraud") -> dict[str, int]:
    """Write the left join and check it in the same pass.

    The features are computed once.  Rows and unlabelled rows are observed
    while they are written; duplicates come from the key column of what was
    written and from the labels.  Returns the report of ``labelled_join``.
    """
    require_columns(features, [key], "features")
    require_columns(labels, [key, label], "labels")
    seen = Observation()
    j = features.drop(label).join(labels.select(key, label), on=key, how="left")
    j.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(label).isNull()).alias("unlabelled")) \
        .write.mode("overwrite").parquet(path)
    out = features.sparkSession.read.schema(j.schema).parquet(path)
    written = out.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    given = labels.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("l"))
    copies = F.col("c") > F.coalesce("l", F.lit(1))                      # more rows than one feature row makes
    dupes = written.join(given, F.col(key) == F.col("_key"), "full").agg(
        F.count_if(copies).alias("feature_dupes"), F.count_if(F.col("l") > 1).alias("label_dupes")).first()
    return seen.get | dupes.asDict()


def assert_contract(report: DataFrame) -> None:
    r = report.collect()[0].asDict()
    bad = {k: v for k, v in r.items() if k != "rows" and v}
    if bad:
        raise ValueError(f"contract violated: {bad}")
