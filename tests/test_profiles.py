"""Maintained profiles: batches answered from them equal the lookup in the whole history."""

import decimal
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import features as FE
from riskloom.operators import profiles as PR
from riskloom.streaming import jobs as SJ

SCHEMA = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, DeviceInfo string"
COLS = ["TransactionID", *FE.CARD_FEATURES, *FE.DEVICE_FEATURES]


def rows(seed, start, n, days=4):
    """Times out of order over a few days, on second ties and day edges; a third on one card and one device."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        t = rng.choice([rng.randrange(days * 86_400), rng.randrange(days) * 86_400, 86_400 + rng.randrange(5), 90_000])
        card = rng.choice([1, 1, rng.randrange(2, 9), None])
        dev = rng.choice(["d1", "d1", f"d{rng.randrange(5)}", None, " "])
        out.append((start + k, t, rng.choice([None, round(rng.random() * 50, 2), 10.0]), card, dev))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def result(df):
    return sorted(df.select(*COLS).collect())


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def brute(batch, history):
    """The 13 features of each row against the strictly earlier rows of ``history``, one row at a time."""
    out = []
    for tid, t, amt, card, dev in batch:
        ok = dev is not None and dev.strip() != ""
        own = [h for h in history if card is not None and h[3] == card and h[1] < t]
        amounts = [h[2] for h in own if h[2] is not None]
        mean = float(sum(map(decimal.Decimal, map(str, amounts)))) / len(amounts) if amounts else 0.0
        on = [h for h in history if ok and h[4] == dev]
        old = [h for h in on if h[1] < t]
        pair = [h for h in old if card is not None and h[3] == card]
        trailing = [sum(t - w <= h[1] for h in own) for w in (3_600, 86_400)]
        out.append((tid, len(own), mean, (amt or 0.0) / mean if mean > 0 else 0.0, int(not own), *trailing, int(ok), len(old),
                    len({h[3] for h in old if h[3] is not None}), int(not ok or not old), len(pair), int(bool(pair)),
                    len({h[3] for h in on if h[3] is not None and h[3] < card}) if ok and card is not None else 0))
    return sorted(out)


def test_batches_equal_the_lookup_in_all_earlier_rows(spark, tmp_path, monkeypatch):
    store, seen = PR.ProfileStore(spark, f"{tmp_path}/store"), rows(0, 0, 120)
    store.add(frame(spark, seen))
    for epoch in range(2):
        data = rows(epoch + 1, 1000 * (epoch + 1), 60)
        batch = frame(spark, data)
        got = result(PR.answer(batch, store, epoch))
        assert got == brute(data, seen)
        store.add(batch, epoch)
        seen = seen + data
    store.add(batch, epoch)                             # a retried epoch
    assert result(PR.answer(batch, store, epoch)) == got
    fresh, probes = PR.ProfileStore(spark, f"{tmp_path}/compacted"), rows(9, 9000, 50)
    store.compact(1, fresh)
    monkeypatch.setattr(PR, "DIRECT_PAIRS", 0)
    assert result(PR.answer(frame(spark, probes), fresh, 0)) == brute(probes, seen)
    assert fresh.read("seconds", 0).count() == len({(h[3], h[4], h[1]) for h in seen})


def test_empty_store_and_empty_batch(spark, tmp_path):
    store, data = PR.ProfileStore(spark, f"{tmp_path}/none"), rows(3, 0, 20)
    assert result(PR.answer(frame(spark, data), store, 0)) == brute(data, [])
    store.add(frame(spark, data), 0)
    assert PR.answer(frame(spark, []), store, 1).count() == 0


def test_profile_rows_read_follow_the_batch(spark, tmp_path):
    """A batch reads the folders of its own days, however many days the history has."""
    store = PR.ProfileStore(spark, f"{tmp_path}/days")
    store.add(frame(spark, [(k, k * 86_400, 1.0, 1, "d") for k in range(30)]))
    batch = frame(spark, [(100, 29 * 86_400 + 5, 1.0, 1, "d")])
    got = PR.answer(batch, store, 0)
    assert got.first().card_transaction_count == 30 and got.first().card_txn_count_24h == 1
    seconds = store.read("seconds", 0).where(F.col("day").isin([28, 29]))
    assert len(seconds.inputFiles()) == 30 and seconds.count() == 2      # the scan itself prunes to two folders
    plan = seconds._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.split("PartitionFilters")[1].split("]")[0]


def test_stream_over_five_files(spark, tmp_path):
    """Every file is answered as if all earlier files (and none of its own rows) were history."""
    src, history = f"{tmp_path}/in", rows(20, 0, 80)
    batches = [rows(21 + k, 1000 * (k + 1), 30) for k in range(5)]
    for b in batches:
        frame(spark, b).coalesce(1).write.mode("append").parquet(src)
        __import__("time").sleep(1.1)                    # the file source orders by modification time
    store = PR.ProfileStore(spark, f"{tmp_path}/store")
    store.add(frame(spark, history))
    known = [r for b in batches for r in b if r[0] % 3 > 0]
    identity = frame(spark, known).select("TransactionID", "DeviceInfo")
    arrivals = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src).drop("DeviceInfo")
    SJ.run_to_end(SJ.score_arrivals(arrivals, store, f"{tmp_path}/out", f"{tmp_path}/ckpt", identity=identity))
    out = spark.read.parquet(f"{tmp_path}/out")
    got, want = result(out), []
    for b in batches:
        b = [r if r[0] % 3 > 0 else (*r[:4], None) for r in b]
        want += brute(b, history)
        history = history + b
    assert got == sorted(want)
    assert all(r.has_identity == int(r.TransactionID % 3 > 0) for r in out.select("TransactionID", "has_identity").collect())
