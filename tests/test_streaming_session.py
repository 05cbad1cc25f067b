"""Streams agree with the batch answer; lineage is cut into the configured folder."""

from pyspark.sql import functions as F

from riskloom.operators import features as FE
from riskloom.plans import catalog as CT
from riskloom.session import cut_lineage, ensure_checkpoint_dir
from riskloom.sources import bindings as B

SF = "/root/testdata/sf0.001"


def test_stream_velocity_equals_batch_pit(spark):
    got = {r.TransactionID: (r.card_txn_count_1h, r.card_txn_count_24h)
           for r in CT.QUERIES["stream_velocity"](spark, SF).collect()}
    t = B.transactions(spark, SF).withColumn("DeviceInfo", F.lit(None).cast("string")) \
        .withColumn("_h", F.lit(1)).withColumn("_o", F.lit(1))
    exp = {r.TransactionID: (r.card_txn_count_1h, r.card_txn_count_24h)
           for r in FE.behaviour(t, "pit").collect()}
    assert got == exp


def test_stream_feedback_only_valid_labels(spark):
    rows = CT.QUERIES["stream_feedback"](spark, SF).collect()
    assert rows and all(r.analyst_label in ("CONFIRMED_FRAUD", "FALSE_POSITIVE", "LEGITIMATE",
                                           "NEEDS_MORE_INFORMATION") for r in rows)


def test_checkpoint_dir_respected(spark):
    d = ensure_checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir()
    df = cut_lineage(B.transactions(spark, SF).select("TransactionID"))
    assert df.count() == B.transactions(spark, SF).count()


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "device_unique_cards_historical" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())


def test_scale_conf_grows_with_input():
    from riskloom.session import scale_conf
    small, big = scale_conf(10 ** 9), scale_conf(100 * 10 ** 12)
    assert int(small["spark.sql.shuffle.partitions"]) == 200
    assert int(big["spark.sql.shuffle.partitions"]) > 500_000
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_late_events_within_the_watermark(spark, tmp_path):
    """Several out-of-order files: every row counts all strictly earlier events that came with it or before it."""
    from riskloom.streaming import jobs as SJ
    files = [[(1, 0), (2, 36_000)], [(3, 100_000)], [(4, 80_000), (5, 100_000)], [(6, 186_000), (7, 99_000)], [(8, 100_001)]]
    src = f"{tmp_path}/in"
    schema = "TransactionID long, card1 long, TransactionDT long"
    for i, rows in enumerate(files):
        spark.createDataFrame([(k, 9, t) for k, t in rows], schema).coalesce(1).write.mode("append").parquet(src)
        __import__("time").sleep(1.1)       # the file source orders by modification time
    ev = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (SJ.card_velocity(ev).writeStream.format("parquet").option("path", f"{tmp_path}/out")
         .option("checkpointLocation", f"{tmp_path}/ckpt").outputMode("append").trigger(availableNow=True).start())
    SJ.run_to_end(q)
    got = {r.TransactionID: (r.card_txn_count_1h, r.card_txn_count_24h) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    seen, want = [], {}
    for rows in files:
        seen += [t for _, t in rows]
        for k, t in rows:
            want[k] = tuple(sum(t - w <= s < t for s in seen) for w in (3_600, 86_400))
    assert got == want and want[4] == (0, 2)


def test_cluster_without_checkpoint_folder_is_an_error(spark, monkeypatch):
    import pytest
    from riskloom import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *a):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())


def test_unrelated_history_stays_out_of_the_lookup(spark):
    from riskloom.operators import history as H
    schema = "TransactionID long, TransactionDT long, TransactionAmt double, card1 long, DeviceInfo string"
    hist = spark.createDataFrame([(i, i, 1.0, i % 50, f"d{i % 40}") for i in range(1000)], schema)
    probes = spark.createDataFrame([(5000, 10_000, 1.0, 3, "d7"), (5001, 10_000, 1.0, None, None)], schema)
    for limit in (10, 0):
        kept = H.relevant(probes, hist, limit)
        assert kept.columns == hist.columns
        assert sorted(r.TransactionID for r in kept.collect()) == [i for i in range(1000) if i % 50 == 3 or i % 40 == 7]


def test_feedback_that_arrives_again_is_appended_once(spark, tmp_path):
    """Twice in one file, in two files of a run, and in a later run with the same checkpoint."""
    from riskloom.streaming import jobs as SJ
    schema = "transaction_id long, analyst_label string"
    rows = [(1, "LEGITIMATE"), (1, "LEGITIMATE"), (1, "FALSE_POSITIVE"), (2, "LEGITIMATE"), (3, "nonsense"), (None, "LEGITIMATE")]

    def feed(data):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        fb = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        SJ.run_to_end(SJ.feedback_sink(fb, f"{tmp_path}/out", f"{tmp_path}/ckpt"))
        return sorted((r.transaction_id or 0, r.analyst_label) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    feed(rows)
    feed(rows)
    once = [(0, "LEGITIMATE"), (1, "FALSE_POSITIVE"), (1, "LEGITIMATE"), (2, "LEGITIMATE")]
    assert run() == once
    feed([*rows, (4, "LEGITIMATE")])
    assert run() == [*once, (4, "LEGITIMATE")]
