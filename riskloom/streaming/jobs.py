"""Streams of arriving transactions and feedback.

* X1 ``score_arrivals``: each micro-batch of arrivals is answered against the
  maintained profiles of its cards and devices (``operators/profiles``) and then
  added to them (``foreachBatch``); every epoch overwrites its own output and
  profile folders, so a retried epoch is idempotent.
* X2 ``card_velocity``: trailing 1 h / 24 h counts per card with event-time
  state (``applyInPandasWithState``); state keeps the last 24 h plus the delay
  of event times per card and is dropped by an event-time timeout after the watermark.
* X3 ``feedback_sink``: validated feedback appended by the file sink
  (exactly-once with its checkpoint), each (transaction, label) once within a
  time bound — no read-modify-write of a JSON file.

Checkpoints and sinks live under the session's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskloom.functions import columns as C
from riskloom.functions import text as TX
from riskloom.operators import features as FE
from riskloom.operators import history as H
from riskloom.operators import policy as PO
from riskloom.operators import profiles as PR
from riskloom.operators import rules as R
from riskloom.session import cut_lineage, ensure_checkpoint_dir

HOUR, DAY = 3600, 86400
#: Added to event seconds for the watermark, which starts at the epoch: times from zero on are then not late.
SHIFT = 1_000_000_000


def stream_dir(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:12]}"


def file_stream(spark: SparkSession, directory: str, name: str, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    """A file source over ``directory/name.<fmt>`` (one table of the shared data)."""
    schema = spark.read.format(fmt).load(f"{directory}/{name}.{fmt}").schema
    r = spark.readStream.schema(schema).option("basePath", directory)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # a glob keeps the file source from treating the single file as a directory
    return r.format(fmt).load(f"{directory}/{name[:-1]}[{name[-1]}].{fmt}")


# ---------------------------------------------------------------------------
# X1
# ---------------------------------------------------------------------------
def score_arrivals(arrivals: DataFrame, profiles: PR.ProfileStore, sink: str, checkpoint: str,
                   params: R.RuleParams | None = None, fusion: PO.FusionConfig | None = None,
                   model: Callable[[DataFrame], Column] | None = None, review_threshold: float = 0.50,
                   identity: DataFrame | None = None, raw_columns: Sequence[str] | None = None, learn: bool = True):
    """Start the X1 stream (availableNow); returns the StreamingQuery.

    ``profiles`` holds the history (``ProfileStore.add``); with ``learn`` every
    batch is added to it after it is answered, so the next batch has it as
    history.  ``identity`` gives arrivals their first device and says whether
    they have an identity row at all; without it arrivals carry both columns.
    ``raw_columns`` are those that count as missing values.  ``model`` maps the
    batch with its 21 features to a score column.  With a model every row is
    scored, fused with the rules and decided (a row whose score fails goes to
    review); without one the rules decide.
    """
    def handle(batch: DataFrame, epoch_id: int) -> None:
        if identity is not None:
            ids = batch.select("TransactionID").distinct()
            batch = FE.attach_identity(batch, identity.join(ids, "TransactionID", "left_semi"))
        elif "has_identity" not in batch.columns:
            batch = batch.withColumn("has_identity", F.col("DeviceInfo").isNotNull().cast("int"))
        batch = cut_lineage(FE.basic_features(batch, raw_columns))
        feats = H.cold_start(PR.answer(batch, profiles, epoch_id))
        scored = feats.withColumn("model_score", C.finite_or_null(model(feats)) if model else F.lit(None).cast("double"))
        scored = R.evaluate(scored, params, "model_score" if model else None)
        scored = PO.fuse(scored.withColumn("calibrated_model_score", F.coalesce("model_score", F.lit(0.0))),
                         fusion or PO.FusionConfig())
        present = F.col("model_score").isNotNull()
        decision = PO.decide(F.when(present, F.col("final_risk_score")), F.coalesce("model_score", F.lit(0.0)),
                             F.col("behavioral_risk_level"), review_threshold)
        out = (scored.withColumn("decision", PO.fail_closed(F.when(present, decision) if model else decision))
               .withColumn("rule_ids", R.rule_ids()).drop("rules_triggered"))
        out.write.mode("overwrite").parquet(f"{sink}/epoch={epoch_id}")
        if learn:
            profiles.add(batch, epoch_id)

    return (arrivals.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# ---------------------------------------------------------------------------
# X2
# ---------------------------------------------------------------------------
VELOCITY_OUT = T.StructType([
    T.StructField("TransactionID", T.LongType()), T.StructField("card1", T.LongType()),
    T.StructField("TransactionDT", T.LongType()), T.StructField("card_txn_count_1h", T.LongType()),
    T.StructField("card_txn_count_24h", T.LongType())])
# distinct event seconds of a card and how often each occurred: at most one entry per second kept
VELOCITY_STATE = T.StructType([T.StructField("seconds", T.ArrayType(T.LongType())),
                               T.StructField("counts", T.ArrayType(T.LongType()))])


def card_velocity(events: DataFrame, delay_s: int = DAY) -> DataFrame:
    """X2 stream: per-event trailing counts; rows later than the watermark (``delay_s``) are dropped.

    A row that is late by less than the delay may need events up to 24 h before
    it, so a card keeps the seconds of the last 24 h plus the delay.  A row's
    counts cover all events that arrived with it or before it.
    """
    kept, shift = DAY + delay_s, SHIFT

    # Local function: shipped to the Python workers by value.
    def _velocity(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old, old_n = (np.array(x, dtype=np.int64) for x in (state.get if state.exists else ([], [])))
        rows = [(b["TransactionID"].to_numpy(), b["TransactionDT"].to_numpy(dtype=np.int64)) for b in batches]
        new, new_n = np.unique(np.concatenate([t for _, t in rows]), return_counts=True)
        seconds, back = np.unique(np.concatenate([old, new]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([old_n, new_n]), minlength=len(seconds)).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(counts)])

        def before(t: np.ndarray) -> np.ndarray:
            return upto[np.searchsorted(seconds, t, side="left")]

        newest = int(seconds[-1])
        keep = seconds >= newest - kept
        state.update((seconds[keep].tolist(), counts[keep].tolist()))
        state.setTimeoutTimestamp((newest + kept + shift) * 1000)
        for ids, t in rows:     # strictly earlier seconds only: times in [t - w, t - 1]
            yield pd.DataFrame({"TransactionID": ids, "card1": key[0], "TransactionDT": t,
                                "card_txn_count_1h": before(t) - before(t - HOUR),
                                "card_txn_count_24h": before(t) - before(t - DAY)})

    ev = events.withColumn("_ts", F.timestamp_seconds(F.col("TransactionDT") + F.lit(SHIFT))).withWatermark("_ts", f"{delay_s} seconds")
    return ev.groupBy("card1").applyInPandasWithState(
        _velocity, VELOCITY_OUT, VELOCITY_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------------------
# X3
# ---------------------------------------------------------------------------
def feedback_sink(feedback: DataFrame, sink: str, checkpoint: str, allowed: Sequence[str] = TX.FEEDBACK_LABELS,
                  within: str = "7 days"):
    """Append validated feedback (with a UTC ingestion timestamp) to a Parquet sink.

    The same (transaction, label) is appended once, however often it arrives within ``within`` of its first arrival;
    state older than that is dropped by the watermark on the ingestion time.
    """
    ok = feedback.where(F.col("analyst_label").isin(list(allowed))).withColumn("timestamp", F.current_timestamp())
    once = ok.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(["transaction_id", "analyst_label"])
    return (once.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def run_to_end(query, timeout_s: int | None = None) -> None:
    """Wait until the stream has ended; with a limit, one that has not ended by then is stopped and is an error."""
    if timeout_s is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout_s} s")
    if query.exception():
        raise query.exception()
