"""Session construction and the few cluster settings the library relies on.

The library never creates a global session: every operator takes DataFrames.
``get_spark`` exists for tests, ``bench.py`` and scripts.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job of the library is written against.  AQE re-plans joins
# from runtime sizes (broadcast when a side turns out small, skew-split a hot
# partition) and coalesces tiny shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of iterative jobs are removed once no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "encyclo",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...) folder
    and is used as is.  Only when it is unset (local tests) a scratch folder is
    created so that ``DataFrame.checkpoint()`` works.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="encyclo-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stored(df, name: str, by: str | None = None):
    """Write ``df`` as Parquet under the checkpoint folder (a folder per value of ``by``).

    Returns the table as stored, which prunes columns and partitions, and a
    function that deletes it."""
    import uuid
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    spark = df.sparkSession

    def drop() -> None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    return spark.read.schema(df.schema).parquet(path), drop


def drop_unused_shuffles(spark) -> None:
    """Have the cleaner delete shuffle files of finished rounds: it acts on what the
    driver's collector finds unreachable, which by itself runs every half hour."""
    import gc
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the cluster's checkpoint folder (set up first
    when the session has none, as in tests).  Never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
