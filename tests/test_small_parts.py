"""Parts that no registered query calls on its own."""

import json

import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import features as FE
from riskloom.operators import history as H
from riskloom.operators import ml as ML
from riskloom.operators import profile as PF
from riskloom.operators import records as RC
from riskloom.sources import bindings as B
from riskloom.sources import io as IO

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def txns(spark):
    return B.transactions(spark, SF)


def test_device_view_joins_the_first_device(spark, txns):
    ident = spark.createDataFrame([(1, "b"), (1, "a"), (2, None), (10**9, "z")], "TransactionID long, DeviceInfo string")
    got = H.device_view(txns, ident).select("TransactionID", "DeviceInfo").collect()
    assert [(r.TransactionID, r.DeviceInfo) for r in got] == [(1, "a")]


def test_column_lists_and_null_tests(spark):
    assert C.non_identity_columns(["TransactionID", "a", "b"], ["TransactionID", "b"]) == ["TransactionID", "a"]
    df = spark.createDataFrame([(None, 1), (None, None)], "a int, b int")
    assert [r[0] for r in df.select(C.all_null(["a", "b"])).collect()] == [0, 1]
    assert [r[0] for r in df.select(C.any_null([])).collect()] == [1, 1]


def test_transaction_view_and_labels(txns):
    v = RC.transaction_view(txns.withColumn("DeviceInfo", F.lit("x")))
    assert v.columns == RC.TXN_FIELDS
    assert IO.read_labels(txns).columns == ["TransactionID", "isFraud"]


def test_report_file_has_no_infinite_values(spark, tmp_path):
    rows = spark.createDataFrame([("r", "s", "a", float("inf")), ("r", "s", "b", 1.5)], "report string, section string, metric string, value double")
    IO.write_report(rows, f"{tmp_path}/r")
    lines = [json.loads(x) for x in spark.read.text(f"{tmp_path}/r").toPandas()["value"]]
    assert {x["metric"]: x.get("value") for x in lines} == {"a": None, "b": 1.5}


def test_wide_crosstab_shares(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 1)], "hour int, isFraud int")
    got = {r["hour"]: (r["0"], r["1"]) for r in PF.crosstab_wide(df, "hour", "isFraud", [0, 1]).collect()}
    assert got[2] == (0.0, 1.0) and abs(got[1][0] - 2 / 3) < 1e-12


def test_feature_store_layout(spark, txns):
    f = FE.feature_store(FE.build(txns, B.identity(spark, SF)))
    assert f.columns == ["TransactionID", "TransactionDT", "card1", "DeviceInfo", *C.MODEL_FEATURES]


def test_written_order_is_the_time_order(spark, txns, tmp_path):
    IO.write_table(txns, f"{tmp_path}/t", ["TransactionDT", "TransactionID"])
    ranges = []
    for part in sorted(p for p in tmp_path.joinpath("t").iterdir() if p.suffix == ".parquet"):
        rows = [tuple(r) for r in spark.read.parquet(str(part)).select("TransactionDT", "TransactionID").collect()]
        assert rows == sorted(rows)
        ranges.append((rows[0], rows[-1]))
    assert all(a[1] < b[0] for a, b in zip(sorted(ranges), sorted(ranges)[1:], strict=False))


def test_saved_model_scores_alike(spark, txns, tmp_path):
    f = FE.build(txns, B.identity(spark, SF))
    model = ML.train_logistic(f)
    ML.save(model, f"{tmp_path}/m")
    a, b = (sorted((r.TransactionID, r.model_score) for r in ML.score(m, f).collect()) for m in (model, ML.load(f"{tmp_path}/m")))
    assert a == b


def test_calibration_is_required_unless_raw_is_allowed(spark):
    df = spark.createDataFrame([(1.5,), (0.25,)], "s double")
    with pytest.raises(ValueError):
        ML.calibrate(None, df, "s")
    assert sorted(r[0] for r in ML.calibrate(None, df, "s", allow_raw=True).select("calibrated_model_score").collect()) == [0.25, 1.0]


def test_reports_fail_closed(spark):
    from riskloom.functions import text as TX
    rows = [(1, "score 0.5 LOW APPROVE", "0.5", "LOW", "APPROVE"), (2, None, "0.5", "LOW", "APPROVE"),
            (3, "score 0.5 LOW APPROVE", None, "LOW", "APPROVE"), (4, "score 0.5 LOW APPROVE", "0.5", None, "APPROVE"),
            (5, "score 0.5 LOW APPROVE", "0.5", "LOW", None), (6, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, report string, risk_score string, risk_level string, decision string")
    got = {r.id: r.first_violation for r in TX.validate_reports(df, ["id"]).collect()}
    assert got == {1: None, 2: "missing_report", 3: "score_mismatch", 4: "level_mismatch", 5: "decision_mismatch",
                   6: "missing_report"}


def test_entry_without_the_optional_subpackage():
    import pathlib
    import subprocess
    import sys
    root = pathlib.Path(__file__).resolve().parent.parent
    code = ("import sys; sys.modules['riskloom.llm'] = None; import __spark_entry__ as E; "
            "print(len(E.queries()), any(n.startswith('op') or n == 'pipeline' for n in E.queries()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    from riskloom.plans.catalog import QUERIES
    assert out.stdout.split() == [str(len(QUERIES)), "False"], out.stderr[-500:]


def test_a_stream_that_does_not_end_is_an_error(spark):
    from riskloom.streaming import jobs as SJ
    q = spark.readStream.format("rate").load().writeStream.format("noop").start()
    with pytest.raises(TimeoutError):
        SJ.run_to_end(q, 1)
    assert not q.isActive
