"""What the operators ask of the Spark session: the shared folder and sizes proven before a broadcast."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Rows that may be broadcast at most; callers broadcast only counted or provably smaller tables.
BROADCAST_ROWS = 200_000


def folder_for(configured: str | None, master: str) -> str:
    """The folder to share: the one configured, and without one a temporary folder where there is only this machine.

    On a cluster a machine's own folder would hold a part of the rows on every machine, so there a missing folder is an error.
    """
    if configured:
        return configured
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix="retort-")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; see ``folder_for`` for sessions that name none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(folder_for(spark.conf.get("spark.checkpoint.dir", None), sc.master))
    return sc._jsc.sc().getCheckpointDir().get()


def path_of(uri: str) -> str:
    """The path in a file name, however many slashes its scheme is written with."""
    return urlparse(uri).path


_WRITTEN: list[str] = []


def shared(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; ``release`` deletes it."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, and survives the loss of executors."""
    spark = df.sparkSession
    path = shared(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def erase(spark: SparkSession, path: str) -> None:
    """Delete one table of the shared folder that no other hangs on any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _WRITTEN.remove(path)


def release(spark: SparkSession) -> int:
    """Delete the tables written so far; how many. Results that weren't stored elsewhere can't be read afterwards, so this is for the end of a job."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _WRITTEN:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    n = len(_WRITTEN)
    _WRITTEN.clear()
    return n


def tasks(spark: SparkSession) -> int:
    """Tasks for dear work after a shuffle: a stated number of partitions, which adaptive execution doesn't merge as it merges small ones; several a core, since texts differ in cost."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for dear row-wise work on inputs of few files; larger inputs, and those that come out of a shuffle, are left where they are."""
    if df.isStreaming or "Adaptive" in df._jdf.queryExecution().executedPlan().getClass().getSimpleName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
