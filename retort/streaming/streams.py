"""The functions on streams: they are stateless, so a stream is a batch that doesn't end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retort.functions import molecules as M
from retort.session import shared


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files as a stream; the schema is that of the files there now."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def profile_stream(stream: DataFrame, text_col: str, fields: list[str]) -> DataFrame:
    return M.profile(stream, text_col, fields)


def _timed(stream: DataFrame, time_col: str, late: str) -> DataFrame:
    """Rows with a time, and the watermark on it: an instant is needed, so times without a zone are read as UTC."""
    timed = stream.filter(F.col(time_col).isNotNull()).withColumn("_at", F.to_utc_timestamp(F.col(time_col).cast("timestamp"), "UTC"))
    return timed.withWatermark("_at", late)


def windowed_counts(stream: DataFrame, time_col: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by time window (one every ``slide``, by default side by side) and keys; rows later than ``late`` behind the newest are dropped, as a stream that goes on forever must. Null times belong to no window."""
    return _timed(stream, time_col, late).groupBy(F.window("_at", width, slide), *keys).agg(F.count("*").alias("n"))


def session_counts(stream: DataFrame, time_col: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """Counts by session of the keys: a session ends ``gap`` after its last row. Late and null times as for windows."""
    return _timed(stream, time_col, late).groupBy(F.session_window("_at", gap).alias("session"), *keys).agg(F.count("*").alias("n"))


def in_files(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    """Tables written as one file each, and a stream that takes them one at a time in this order."""
    path = shared(spark, "arrivals")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(path)
        folder = jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(conf)
        # Files are taken by their time: one minute apart, those that came before keep theirs.
        for status in fs.listStatus(folder):
            if status.getPath().getName().startswith("part-") and status.getModificationTime() > 10**12:
                fs.setTimes(status.getPath(), 10**11 + k * 60_000, -1)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_all(stream: DataFrame) -> DataFrame:
    """What is there now, through the stream and into a table in the shared folder. Of windows with a watermark only those it has passed are given out."""
    spark = stream.sparkSession
    root = shared(spark, "stream")
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """An aggregated stream's latest row for each of ``keys``, when all that is there now went through: every batch's changed rows are appended to a table, and the last batch's row of a key counts."""
    spark = stream.sparkSession
    root = shared(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])
    rest = [c for c in stream.columns if c not in keys]
    latest = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/out").groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_row"))
    return latest.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
