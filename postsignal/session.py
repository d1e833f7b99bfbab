"""Spark session and checkpoint-directory helpers.

On a cluster the session is created by the platform; we only read its
settings.  ``spark.checkpoint.dir`` names the shared folder used to cut
lineage (``DataFrame.checkpoint``); a private folder is created only when the
setting is absent, which happens in local tests.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", app: str = "postsignal") -> SparkSession:
    """Session for tests and the local benchmark (never used on a cluster)."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", memory))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring ``spark.checkpoint.dir``.

    Only when neither the context nor the conf names one, in a single-process
    local run (driver and executors are one process), do we create a fresh
    private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="postsignal-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


TASK_ROWS = 4096               # rows that are worth a task of their own
SIDE_BY_SIDE = 4               # calls that run at a time


def few_tasks(df: DataFrame) -> DataFrame:
    """A kept table, read by as many tasks as its rows need and no fewer than there are cores; never by more than it has partitions."""
    return df.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS)))


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once by a checkpoint, so that the plans above it start there, in few tasks; dealt anew where it leaves cores idle
    (ranks within classes bring a small table's rows to a task per class)."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.checkpoint()
    needed = min(df.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // TASK_ROWS))
    return kept.repartition(needed) if kept.rdd.getNumPartitions() < needed else few_tasks(kept)


def drop_checkpoint(kept: DataFrame) -> None:
    """Delete the files of a checkpointed table that nobody reads any more."""
    sc = kept.sparkSession.sparkContext
    path = kept._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if path.isDefined():
        where = sc._jvm.org.apache.hadoop.fs.Path(path.get())
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def side_by_side(calls: list[Callable], most: int = SIDE_BY_SIDE) -> list:
    """What the calls return, in their order.  Each waits for jobs of its own, so up to ``most`` run at a time in threads of the driver."""
    if len(calls) < 2:
        return [c() for c in calls]
    inheriting = inheritable_thread_target(SparkSession.getActiveSession() or SparkSession.builder.getOrCreate())
    with ThreadPool(min(most, len(calls))) as pool:
        return pool.map(lambda c: c(), [inheriting(c) for c in calls], chunksize=1)
