"""Session construction and the shared checkpoint folder.

On a cluster the checkpoint folder is whatever the cluster names in
``spark.checkpoint.dir`` (a shared, fault-tolerant file system).  Only when
that setting is missing *and* Spark runs in local mode (tests, laptops) do we
create a scratch folder of our own.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of DataFrames that are garbage-collected are deleted
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(app: str = "aislekit", cores: int | str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the cluster's own."""
    cores = cores or os.environ.get("BENCH_CPUS") or "*"
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 8)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # not set anywhere
            configured = None
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder of the cluster")
        configured = tempfile.mkdtemp(prefix="aislekit-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: Rows of a table of classes or the like that may go to every task.
BROADCAST_ROWS = 100_000


def small(df):
    """``df``, a kept table, marked for broadcast if it has at most ``BROADCAST_ROWS`` rows (counted); else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def spread(df):
    """``df`` over at least as many tasks as there are cores, for text work on few files; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut_lineage(df):
    """Reliable checkpoint: materialise ``df`` in the shared folder and restart lineage.

    Used where one result is read by several branches that must agree
    (range-partition ids, FP-growth output) and where recomputation after an
    executor loss would otherwise redo an expensive stage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files, and kept tables where it is set to, of finished steps: it does once the driver has
    collected their handles, which else happens only now and then."""
    spark.range(1).count()  # listeners may hold the last query until the next one
    for _ in range(2):  # handles that others hold are seen the second time
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)
