"""Behaviour features vs a brute-force Python definition on tie-heavy, null-heavy data,
with and without the hot-key split."""

import random

import pytest

from riskloom.operators import features as FE
from riskloom.operators import history as H
from riskloom.operators.keyed import SkewConfig

COLS = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, DeviceInfo string"


def _rows(seed=7, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        dt = rnd.choice([0, 3600, 3601, 7200, 86400, 86401, 90000]) + rnd.randrange(0, 5) * rnd.choice([0, 1, 3600])
        card = rnd.choice([1, 1, 1, 2, 3, None]) if i % 17 else None
        dev = rnd.choice(["a", "a", "b", "c", None, " ", "UNKNOWN-DEVICE"])
        amt = rnd.choice([None, 0.0, 10.0, 25.5, 100.0])
        rows.append((i + 1, dt, amt, card, dev))
    return rows


def _before(h, t, sem):
    if sem == "batch":
        return (h[1], h[0]) < (t[1], t[0])
    return h[1] < t[1]


def brute(rows, sem):
    out = {}
    for t in rows:
        tid, dt, amt, card, dev = t
        dev_ok = dev is not None and (sem == "batch" or dev.strip() != "")
        prev = [h for h in rows if _before(h, t, sem)]
        pc = [h for h in prev if card is not None and h[3] == card]
        if sem == "batch":
            cnt = len(pc) if card is not None else None
            s = sum(h[2] for h in pc if h[2] is not None)
            avg = (s / cnt) if (card is not None and amt is not None and cnt) else None
        else:
            cnt = len(pc)
            nn = [h[2] for h in pc if h[2] is not None]
            avg = sum(nn) / len(nn) if nn else 0.0
        v1 = len([h for h in pc if h[1] >= dt - 3600]) if card is not None else 0
        v24 = len([h for h in pc if h[1] >= dt - 86400]) if card is not None else 0
        pd_ = [h for h in prev if dev_ok and h[4] == dev]
        w7 = len(pd_) if dev_ok else 0
        w8 = len({h[3] for h in pd_ if h[3] is not None}) if dev_ok else 0
        pair = [h for h in pd_ if card is not None and h[3] == card]
        w10 = len(pair) if (dev_ok and card is not None) else 0
        smaller = len({h[3] for h in rows if dev_ok and h[4] == dev and h[3] is not None and card is not None
                       and h[3] < card}) if (dev_ok and card is not None) else 0
        w12 = smaller + (1 if (sem == "batch" and w10 > 0) else 0) if (dev_ok and card is not None) else 0
        out[tid] = {"card_transaction_count": cnt, "card_avg_amount": avg, "card_txn_count_1h": v1,
                    "card_txn_count_24h": v24, "device_profile_count": w7, "device_profile_unique_cards": w8,
                    "card_device_transaction_count": w10, "device_unique_cards_historical": w12}
    return out


@pytest.mark.parametrize("sem", ["batch", "pit"])
@pytest.mark.parametrize("skew", [None, SkewConfig(min_hot_rows=5, target_rows=3, null_spread=4)])
def test_features_match_bruteforce(spark, sem, skew):
    rows = _rows()
    df = spark.createDataFrame(rows, COLS).withColumn("_h", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)) \
        .withColumn("_o", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1))
    got = {r.TransactionID: r.asDict() for r in FE.behaviour(df, sem, skew).collect()}
    exp = brute(rows, sem)
    assert len(got) == len(exp)
    for tid, e in exp.items():
        for k, v in e.items():
            g = got[tid][k]
            if v is None or g is None:
                assert v is None and g is None, (sem, tid, k, g, v)
            else:
                assert abs(g - v) < 1e-9, (sem, tid, k, g, v)


def test_lookup_probes_see_only_history(spark):
    rows = _rows(3, 200)
    hist = spark.createDataFrame(rows[:150], COLS)
    probes = spark.createDataFrame(rows[150:], COLS)
    got = {r.TransactionID: r for r in H.lookup(probes, hist).collect()}
    for t in rows[150:]:
        pc = [h for h in rows[:150] if t[3] is not None and h[3] == t[3] and h[1] < t[1]]
        assert got[t[0]].card_transaction_count == len(pc)


def test_invariants_on_testdata(spark):
    from pyspark.sql import functions as F
    from riskloom.sources import bindings as B
    f = FE.build(B.transactions(spark, "/root/testdata/sf0.001"), B.identity(spark, "/root/testdata/sf0.001"))
    bad = f.where((F.col("card_txn_count_24h") < F.col("card_txn_count_1h"))
                  | ((F.col("card_device_seen_before") == 1) != (F.col("card_device_transaction_count") > 0))).count()
    assert bad == 0


@pytest.mark.parametrize("skew", [None, SkewConfig(min_hot_rows=5, target_rows=3, null_spread=4)])
def test_card_profile_matches_bruteforce(spark, skew):
    rows = _rows(11, 300)
    hist, probes = rows[:220], rows[220:]
    got = {r.TransactionID: r for r in H.card_profile(spark.createDataFrame(probes, COLS),
                                                      spark.createDataFrame(hist, COLS), skew).collect()}
    for t in probes:
        prev = [h for h in hist if t[3] is not None and h[3] == t[3] and h[1] < t[1]]
        amts = [h[2] for h in prev if h[2] is not None]
        g = got[t[0]]
        assert g.card_history_count == len(prev)
        assert abs(g.card_history_mean - (sum(amts) / len(amts) if amts else 0.0)) < 1e-9
        assert g.card_history_max == (max(amts) if amts else 0.0)
        assert g.card_history_min == (min(amts) if amts else 0.0)


@pytest.mark.parametrize("semantics", ["batch", "pit"])
@pytest.mark.parametrize("min_hot_rows", [10**9, 5])
def test_rows_of_a_sorting_task_are_bounded(spark, semantics, min_hot_rows):
    """The tasks of the windows grow in number with the rows, and the features stay the same."""
    from riskloom.operators import features as FE
    rows = [(i, 60 * i, float(i % 7), i % 50, f"d{i % 40}", 1, 1) for i in range(400)]
    frame = spark.createDataFrame(rows, "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, "
                                        "DeviceInfo string, _h int, _o int")
    skew = SkewConfig(min_hot_rows=min_hot_rows, target_rows=3, null_spread=4, task_rows=10)
    out = FE.behaviour(frame, semantics, skew)
    assert out.rdd.getNumPartitions() >= 40
    plain = FE.behaviour(frame, semantics, SkewConfig())
    assert sorted(map(tuple, out.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
