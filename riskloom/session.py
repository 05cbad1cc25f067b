"""Spark session helpers.

The library never picks a machine-local folder on a cluster: lineage is cut
with ``checkpoint()`` into ``spark.checkpoint.dir`` as configured on the
session; only when that is unset (local tests) do we set one ourselves.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "riskloom") -> SparkSession:
    """Session for tests and the bench (local mode)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir=os.environ.get("RISKLOOM_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss), never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scale_conf(input_bytes: int, partition_bytes: int = 256 << 20, shuffle_expansion: float = 1.5,
               min_partitions: int = 200) -> dict[str, str]:
    """Settings sized to the input volume for a cluster run.

    Scan splits of ``partition_bytes``; shuffle partitions so that the largest
    exchange (the full-width feature shuffle, ~``shuffle_expansion`` x the
    compressed input) lands near ``partition_bytes`` per task before AQE
    coalesces small ones; AQE skew handling splits partitions 4x the advisory
    size.  At 100 TB this gives ~600k shuffle partitions — set it explicitly
    rather than relying on the default 200.
    """
    parts = max(min_partitions, int(input_bytes * shuffle_expansion // partition_bytes) + 1)
    mb = f"{partition_bytes >> 20}m"
    return {
        "spark.sql.files.maxPartitionBytes": mb,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": mb,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{(partition_bytes * 4) >> 20}m",
        # broadcast only what the planner can prove small; our own broadcasts are bounded by construction
        "spark.sql.autoBroadcastJoinThreshold": "64m",
    }


def apply_scale_conf(spark: SparkSession, input_bytes: int, **kw) -> dict[str, str]:
    conf = scale_conf(input_bytes, **kw)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
