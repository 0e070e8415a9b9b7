"""Session helpers: the shared checkpoint folder and the size limits."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BROADCAST_BYTES_KEY = "spark.dyadica.broadcastBytes"
GROUP_ROWS_KEY = "spark.dyadica.groupRows"

# A side is broadcast only when its measured size stays under this. All of it passes through the
# driver, once for every job that reads it, and a cross-validation has several such sides a fold.
DEFAULT_BROADCAST_BYTES = 32 * 1024 * 1024
# A window group (one batch of pairs) is sorted in one task only up to this many rows.
DEFAULT_GROUP_ROWS = 1_000_000
# Spark's option that deletes a job's shuffle files at its end.
SHUFFLE_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Folders written by materialize, by application; release deletes them.
_written: dict[str, list[str]] = {}


def broadcast_bytes(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_KEY, str(DEFAULT_BROADCAST_BYTES)))


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_KEY, str(DEFAULT_GROUP_ROWS)))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared checkpoint folder; make one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return sc.getCheckpointDir()


def materialize(df: DataFrame, tidy: bool = False) -> DataFrame:
    """Write ``df`` once to the checkpoint folder and read it back from there.

    A columnar table lets later stages read only the columns they need, and gives the
    optimizer its true size. With ``tidy`` the shuffle files behind it go once it is written.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP_KEY, "false")
    spark.conf.set(SHUFFLE_CLEANUP_KEY, "true" if tidy else before)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP_KEY, before)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> int:
    """How many tables ``materialize`` has written and not released; a mark for ``release``."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Delete the tables that ``materialize`` wrote for this application after the mark ``since``,
    and up to the mark ``until``, all by default, and say how many.

    Call it when no frame built on them is needed any more, at the end of a job for example.
    """
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone = paths[since:until]
    del paths[since:until]
    delete(spark, gone)
    return len(gone)


def delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(conf).delete(place, True)
