"""Tables in the folder that all executors and the driver share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset in local mode (tests), a folder of this process."""
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_by_cluster:
        return set_by_cluster
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="tamarack-shared-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs the tasks it ran, not the stages before.
    The tables go when the driver process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing stands at yet; what is written there goes when the driver process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop)
    _written[path] = spark
    return path


def _drop() -> None:
    for path, spark in _written.items():
        try:  # one table that cannot be deleted, or a session that has ended, keeps none of the others
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:
            continue
