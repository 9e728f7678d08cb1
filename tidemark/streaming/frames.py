"""Frame-by-frame detection logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_frames(spark: SparkSession, folder: str, like: DataFrame, name: str = "*.parquet", files_per_trigger: int = 1) -> DataFrame:
    """Records from the files of a folder in the order in which they arrive, with the schema of ``like``."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def sampled(frames: DataFrame, stride: int, fps: float, number: str = "frame") -> DataFrame:
    """Every ``stride``-th frame, with ``timestamp_s`` from its number."""
    return frames.where(F.col(number) % stride == 0).withColumn("timestamp_s", F.round(F.col(number) / fps, 3))


def until(frames: DataFrame, most: int, number: str = "frame") -> DataFrame:
    """The frames before a number."""
    return frames.where(F.col(number) < most)


def running_summary(frames: DataFrame, key: str = "event_type") -> DataFrame:
    """``key, n, max_value, tracks`` so far. The distinct tracks are counted from rows that are kept one for each key and track."""
    tracks = frames.groupBy(key, "user_id").agg(F.count("*").alias("n"), F.max("value").alias("max_value"))
    return tracks


def windowed(frames: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """``window_start, key, n`` in tumbling windows, with rows later than the watermark left out. Beyond the batch operators."""
    timed = frames.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")


def run_to_table(stream: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process what is there into an in-memory table and stop; for small states and tests."""
    query = stream.writeStream.format("memory").queryName(table).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there; ``path`` holds the whole state after the last batch, and that of no other."""
    fresh = f"{path}.new"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(fresh)
        jvm = batch.sparkSession._jvm
        old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(fresh)
        files = old.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration())
        files.delete(old, True)
        files.rename(new, old)

    query = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
