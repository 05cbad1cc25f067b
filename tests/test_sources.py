"""Sources and sinks (S1-S14) round-trip through files in the checkpoint folder."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from riskloom.functions import text as TX
from riskloom.session import ensure_checkpoint_dir
from riskloom.sources import bindings as B
from riskloom.sources import io as IO

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def scratch(spark):
    return f"{ensure_checkpoint_dir(spark)}/io-{uuid.uuid4().hex[:8]}"


def test_csv_typed_read_and_header(spark, scratch):
    t = B.transactions(spark, SF)
    t.select(*[F.col(c).cast("string") for c in t.columns], F.lit("x").alias("V1")) \
        .write.option("header", True).csv(f"{scratch}/tx")
    assert "V1" in IO.header_columns(spark, f"{scratch}/tx")
    back = IO.read_csv(spark, f"{scratch}/tx", IO.TRANSACTION_SCHEMA)
    assert back.schema == IO.TRANSACTION_SCHEMA                      # only the pinned columns, typed
    assert back.count() == t.count()
    with pytest.raises(ValueError):
        IO.read_csv(spark, f"{scratch}/tx", IO.IDENTITY_SCHEMA.add("missing_col", "string"))


def test_rejected_lines_are_kept(spark, scratch):
    rows = ["TransactionID,TransactionDT,V1,card1", "1,10,x,5", "2,ten,x,5", "3,30", "4,,x,", "5,50,x,5,more", "6,6.5,x,1", "", "7,70,,9"]
    spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(f"{scratch}/lines")
    schema = IO.T.StructType([f for f in IO.TRANSACTION_SCHEMA if f.name in ("TransactionID", "TransactionDT", "card1")])
    good, rejected = IO.read_csv_checked(spark, f"{scratch}/lines", schema)
    assert good.schema == schema
    assert sorted(tuple(r) for r in good.collect()) == [(1, 10, 5), (4, None, None), (7, 70, 9)]
    assert sorted(r.line for r in rejected.collect()) == [rows[2], rows[3], rows[5], rows[6]]
    assert rejected.count() + good.count() == len(rows) - 2
    assert [good.select("card1").count(), good.select("TransactionID").agg(F.sum("TransactionID")).first()[0]] == [3, 12]
    with pytest.raises(ValueError):
        IO.read_csv_checked(spark, f"{scratch}/lines", IO.IDENTITY_SCHEMA)


def test_empty_table_when_absent(spark, scratch):
    df = IO.read_table_or_empty(spark, f"{scratch}/nothing", IO.IDENTITY_SCHEMA)
    assert df.count() == 0 and df.schema == IO.IDENTITY_SCHEMA


def test_assessment_map(spark, scratch):
    doc = {"101": {"risk_score": 0.9, "decision": "REVIEW"}, "102": {"risk_score": 0.1, "decision": "APPROVE"}}
    # written through Spark, so the (possibly remote) checkpoint folder URI is handled by Hadoop
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(f"{scratch}/assess")
    rows = {r.TransactionID: json.loads(r.assessment) for r in IO.read_assessments(spark, f"{scratch}/assess").collect()}
    assert rows == {101: doc["101"], 102: doc["102"]}


def test_range_partitioned_write_and_feedback_append(spark, scratch):
    t = B.transactions(spark, SF)
    IO.write_table(t, f"{scratch}/store", order=["TransactionDT", "TransactionID"])
    assert spark.read.parquet(f"{scratch}/store").count() == t.count()
    raw = spark.createDataFrame([(1, "CONFIRMED_FRAUD"), (2, "maybe"), (3, None)], "transaction_id long, analyst_label string")
    acc, rej = IO.validate_feedback(raw, TX.FEEDBACK_LABELS)
    old = spark.createDataFrame([(9, "LEGITIMATE")], "transaction_id long, analyst_label string")
    IO.append_feedback(old, f"{scratch}/fb")
    IO.append_feedback(acc.withColumn("model_score", F.lit(0.5)), f"{scratch}/fb")
    fb = IO.read_feedback(spark, f"{scratch}/fb")
    assert {"model_score", "timestamp"} <= set(fb.columns) and fb.count() == 2 and rej.count() == 2


def test_contracts(spark):
    t = B.transactions(spark, SF)
    IO.require_columns(t, ["TransactionID", "isFraud"])
    with pytest.raises(ValueError):
        IO.require_columns(t, ["nope"])
    dup = t.unionByName(t.limit(3))
    rep = IO.unique_key_report(dup, "TransactionID").collect()[0]
    assert rep.duplicated_keys == 3
    _, rep2 = IO.labelled_join(dup, t.select("TransactionID", "isFraud"))
    with pytest.raises(ValueError):
        IO.assert_contract(rep2)


def test_contract_of_a_join_is_checked_while_it_is_written(spark, scratch):
    """Against plain counting: repeated ids on both sides, null ids, null labels, ids on one side alone."""
    f = [1, 1, 2, 3, 4, 4, None, None, 9]
    lab = [(1, 0), (2, 1), (2, None), (4, None), (7, 1), (None, 1), (None, 0)]
    features = spark.createDataFrame([(k, float(i)) for i, k in enumerate(f)], "TransactionID long, x double")
    labels = spark.createDataFrame(lab, "TransactionID long, isFraud int")
    for how in ("left", "inner"):
        made = [m for k in f for m in ([v for j, v in lab if j == k and k is not None] or (["alone"] if how == "left" else []))]
        j, rep = IO.labelled_join(features, labels, how=how)
        want = {"rows": len(made), "unlabelled": sum(m in (None, "alone") for m in made), "feature_dupes": 3, "label_dupes": 2}
        assert j.count() == want["rows"]
        assert rep.first().asDict() == want
        if how == "left":
            assert IO.write_labelled(features, labels, f"{scratch}/joined") == want
            assert spark.read.parquet(f"{scratch}/joined").count() == want["rows"]
    none = IO.labelled_join(features.limit(0), labels.limit(0))[1].first()
    assert tuple(none) == (0, 0, 0, 0)
    with pytest.raises(ValueError):
        IO.write_labelled(features, labels.drop("isFraud"), f"{scratch}/never")


def test_history_grows_by_days(spark, scratch):
    """Only the days of new rows are rewritten, files are sorted, and rows added again change nothing."""
    import glob

    from riskloom.operators import history as H
    from riskloom.sources import history_store as HS
    schema = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, DeviceInfo string"
    make = lambda ids: spark.createDataFrame([(i, (i * 7919) % 400_000, float(i), i % 5, "d") for i in ids], schema)
    path = f"{scratch}/history"

    def files():
        return {d: sorted(glob.glob(f"{path.removeprefix('file:')}/day={d}/*.parquet")) for d in range(-1, 6)}

    assert HS.add_rows(make(range(300)), path) == [0, 1, 2, 3, 4]
    first = files()
    extra = spark.createDataFrame([(1000, 2 * 86_400 + 5, 1.0, 1, None), (1001, None, 2.0, 1, None)], schema)
    assert HS.add_rows(extra.unionAll(extra), path) == [-1, 2]
    second = files()
    assert [d for d in first if first[d] != second[d]] == [-1, 2]
    assert HS.add_rows(make(range(0, 300, 3)).unionAll(extra), path) == [-1, 0, 1, 2, 3, 4]
    assert HS.add_rows(extra.limit(0), path) == []
    rows = [tuple(r) for r in HS.read_days(spark, path).select(*extra.columns).collect()]
    assert sorted(rows, key=lambda r: r[0]) == [tuple(r) for r in make(range(300)).collect()] + [tuple(r) for r in extra.collect()]
    for name in sum(files().values(), []):
        times = [(r.TransactionDT or 0, r.TransactionID) for r in spark.read.parquet(name).coalesce(1).collect()]
        assert times == sorted(times)
    probes = spark.createDataFrame([(5000, 90_000, 1.0, 1, "d")], schema)
    near = HS.before(probes, path)
    assert {r.TransactionDT // 86_400 for r in near.where("TransactionDT IS NOT NULL").collect()} == {0, 1}
    assert "day" in near._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    whole = HS.read_days(spark, path).drop("day")
    assert H.lookup(probes, near).collect() == H.lookup(probes, whole).collect()
    other = spark.createDataFrame([(7, 4 * 86_400 + 1, 1.0, 1, "d")], schema)
    for again in (other, make([7]), other):
        HS.add_rows(again, path)
    assert sorted(r.TransactionDT for r in HS.read_days(spark, path).where("TransactionID = 7").collect()) == [55_433, 4 * 86_400 + 1]
    with pytest.raises(ValueError):
        HS.add_rows(extra.withColumn("TransactionID", F.lit(None).cast("long")), path)
