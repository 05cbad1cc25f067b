"""The reference's unit fixtures, restated as tiny DataFrames."""

import pytest
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators import history as H
from riskloom.operators import metrics as M
from riskloom.operators import policy as PO
from riskloom.operators import rules as R
from riskloom.operators.keyed import SkewConfig

HIST = [(101, 1000, 11111, 50.0, "iOS-Device"), (102, 2000, 11111, 100.0, "iOS-Device"),
        (103, 1500, 22222, 200.0, "Android-Device")]
COLS = "TransactionID long, TransactionDT long, card1 long, TransactionAmt double, DeviceInfo string"
SMALL = SkewConfig(min_hot_rows=1, target_rows=1)


def _cold(spark, probe, skew=None):
    h = spark.createDataFrame(HIST, COLS)
    p = spark.createDataFrame([probe], COLS)
    return H.cold_start(H.lookup(p, h, skew)).collect()[0]


def test_cold_start_known_card_and_device(spark):
    r = _cold(spark, (1, 3000, 11111, 10.0, "iOS-Device"))
    assert not r.is_new_card and not r.is_new_device and not r.is_new_card_device_pair


def test_cold_start_nothing_known(spark):
    r = _cold(spark, (2, 10699421, 99999, 10.0, "UNKNOWN-DEVICE"))
    assert r.is_new_card and r.is_new_device and r.is_new_card_device_pair


def test_cold_start_known_card_new_device(spark):
    r = _cold(spark, (3, 3000, 11111, 10.0, "New-Brand-Phone"))
    assert not r.is_new_card and r.is_new_device and r.is_new_card_device_pair


def test_cold_start_new_card_known_device(spark):
    r = _cold(spark, (4, 3000, 88888, 10.0, "iOS-Device"), SMALL)    # hot-key path too
    assert r.is_new_card and not r.is_new_device and r.is_new_card_device_pair


def _rules(spark, row, model_score=None, params=None):
    schema = ("TransactionAmt double, card_txn_count_1h long, card_txn_count_24h long, "
              "device_profile_unique_cards long, amount_vs_card_avg double, is_new_card boolean, "
              "is_new_device boolean, card_history_available boolean, ms double")
    df = spark.createDataFrame([row + (model_score,)], schema)
    out = R.evaluate(df, params or R.RuleParams(), "ms" if model_score is not None else None)
    return out.collect()[0]


def test_rule_both_new_high_amount_is_medium(spark):
    r = _rules(spark, (600.0, 0, 0, 0, None, True, True, False), 0.10)
    assert [x.rule_id for x in r.rules_triggered] == ["NEW_CARD_NEW_DEVICE_HIGH_AMOUNT"]
    assert r.behavioral_risk_level == "MEDIUM" and r.behavioral_risk_score == 0.50


def test_rule_high_model_risk(spark):
    r = _rules(spark, (100.0, 0, 0, 0, 1.0, False, False, True), 0.95)
    assert [x.rule_id for x in r.rules_triggered] == ["HIGH_MODEL_RISK"]
    assert r.behavioral_risk_level == "HIGH"
    assert r.rules_triggered[0].reason == "Model risk score (0.9500) meets or exceeds high threshold (0.9)."


def test_rule_unusual_amount_needs_history(spark):
    r = _rules(spark, (1000.0, 0, 0, 0, 10.0, True, False, False))
    assert "UNUSUAL_AMOUNT" not in [x.rule_id for x in r.rules_triggered]
    r = _rules(spark, (1000.0, 0, 0, 0, 5.0, False, False, True))
    assert [x.rule_id for x in r.rules_triggered] == ["UNUSUAL_AMOUNT"]


def test_decisions_legacy_path(spark):
    df = spark.createDataFrame([(0.92, "LOW"), (0.0122, "HIGH"), (0.0122, "LOW")], "m double, b string")
    out = df.select(PO.decide(None, F.col("m"), F.col("b")).alias("d")).collect()
    assert [r.d for r in out] == ["REVIEW", "REVIEW", "APPROVE"]


def test_alternate_tiers(spark):
    df = spark.createDataFrame([(0.10,), (0.45,), (0.87,)], "p double")
    out = df.select(C.tier("p", "simple", "decision").alias("d")).collect()
    assert [r.d for r in out] == ["APPROVE", "MONITOR", "REVIEW"]


def test_classification_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    c = M.confusion(df, "y", "s", 0.5).collect()[0]
    assert (c.tn, c.fp, c.fn, c.tp) == (2, 0, 0, 2)
    assert c.precision == c.recall == c.f1 == 1.0
    r = M.ranking_metrics(df, "y", "s").collect()[0]
    assert r.roc_auc == 1.0 and r.average_precision == 1.0


def test_review_capacity(spark):
    df = spark.createDataFrame([(0, 0.1, 1), (0, 0.2, 2), (0, 0.3, 3), (1, 0.9, 4), (1, 0.8, 5)],
                               "y int, s double, TransactionID long").withColumn("TransactionDT", F.col("TransactionID"))
    assert M.review_metrics(df, "y", "s", 0.20)["recall"] == 0.5
    assert M.review_metrics(df, "y", "s", 0.40)["recall"] == 1.0


def test_threshold_sweep_one_row(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y int, s double")
    rows = M.threshold_sweep(df, "y", "s", [0.5]).collect()
    assert len(rows) == 1 and rows[0].review_rate == 0.5


def test_segments_one_row_each(spark):
    from riskloom.plans.jobs import segment_metrics
    df = spark.createDataFrame([(0, 0, 0, 0.1, 1), (0, 1, 1, 0.9, 2), (1, 0, 1, 0.8, 3), (1, 1, 1, 0.7, 4)],
                               "new_card int, new_device_profile int, y int, s double, TransactionID long") \
        .withColumn("TransactionDT", F.col("TransactionID"))
    seg = segment_metrics(df, "y", "s", 0.5)
    assert all(v["count"] == 1 for v in seg.values())


def test_partial_payload(spark):
    from riskloom.operators import records as RC
    base = spark.createDataFrame([(5, 100, 9.0, 13926, "iOS")], "TransactionID long, TransactionDT long, "
                                 "TransactionAmt double, card1 long, DeviceInfo string")
    five = {"TransactionID": "999999997", "card1": "1", "TransactionDT": "1", "TransactionAmt": "5", "DeviceInfo": "x"}
    match = {"card1": "13926.0", "TransactionDT": "100", "TransactionAmt": "5"}
    many = five | {f"V{i}": "0" for i in range(14)}
    p = spark.createDataFrame([(1, five), (2, match), (3, many)], "request_id long, payload map<string,string>")
    got = {r.request_id: r for r in RC.payload_requests(p, base).collect()}
    assert (got[1].synthetic, got[1].completeness) == (False, "PARTIAL")
    assert (got[2].synthetic, got[2].completeness) == (True, "COMPLETE")
    assert (got[2].TransactionID, got[2].TransactionAmt, got[2].DeviceInfo) == ("5", "5", "iOS")
    assert (got[3].synthetic, got[3].completeness) == (False, "COMPLETE")


def test_failed_score_goes_to_review(spark):
    from riskloom.operators import records as RC
    schema = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, DeviceInfo string"
    hist = spark.createDataFrame([(i, i * 100, 10.0, 1, "iOS") for i in range(1, 20)], schema)
    probe = spark.createDataFrame([(90 + i, 10_000_000, 10.0, 1, "iOS", s)
                                   for i, s in enumerate((None, float("nan"), 0.1))], schema + ", s double")
    got = RC.investigate(probe, hist, model_score="s").select("investigation.*").collect()
    assert sorted(r.final_decision for r in got) == ["APPROVE", "REVIEW", "REVIEW"]


def test_nan_fires_no_rule(spark):
    from riskloom.operators import rules as R
    nan = float("nan")
    df = spark.createDataFrame([(nan, nan, 0.0, 0.0, 0.0, nan, False, False, True)],
                               "TransactionAmt double, s double, card_txn_count_1h double, card_txn_count_24h double, "
                               "device_profile_unique_cards double, amount_vs_card_avg double, is_new_card boolean, "
                               "is_new_device boolean, card_history_available boolean")
    assert R.evaluate(df, None, "s").first().rules_triggered == []


def test_missing_table_is_empty_other_errors_are_raised(spark, tmp_path):
    from riskloom.sources import io
    assert io.read_table_or_empty(spark, f"{tmp_path}/nothing", io.FEEDBACK_SCHEMA).count() == 0
    with pytest.raises(Exception):
        io.read_table_or_empty(spark, "nosuchfs://x/y", io.FEEDBACK_SCHEMA).count()


def test_segment_extremes():
    from riskloom.plans.jobs import extreme_segments
    deltas = [("all", -1.0, -1.0), ("a", 0.1, 0.0), ("b", None, None), ("c", 0.1, 0.5), ("d", -0.2, 0.1), ("e", -0.2, 0.0)]
    worst, best = extreme_segments(deltas)
    assert [d[0] for d in worst] == ["e", "d", "a", "c", "b"] and [d[0] for d in best] == ["a", "c", "d", "e", "b"]
