"""Event-time windows over a stream of files; beyond the batch operators, and equal to them when all has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.staging import scratch_path


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """New Parquet files of one table, as a stream with the table's own schema."""
    path = f"{folder}/{name}.parquet"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    is_folder = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if is_folder else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def tumbling_counts(events: DataFrame, at: str, key: str, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, key, n)`` per window; events later than ``late`` are dropped by a stream, counted by a batch."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", every).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")


def sliding_counts(events: DataFrame, at: str, every: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", every, step).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def session_counts(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(key, start, n)`` per session of ``key`` without a pause of ``gap`` or more."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.session_window("__at", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


#: fixed value: later than any event, and within what a timestamp of microseconds holds
FAR = "9000-01-01 00:00:00"


def run_to_end(stream: DataFrame, at: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``build(stream)`` over everything that is there, in append mode: each window is written once, when the watermark
    has passed it, and its state is dropped then. When all is read, one event of the far future, with nothing but its time ``at``,
    closes the windows that are still open; its own never closes, so it does not come out. Both runs share a checkpoint."""
    spark = stream.sparkSession
    out, marks, closing = (scratch_path(spark, f"stream-{x}") for x in ("out", "marks", "closing"))
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(closing)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    shaped = build(stream.unionByName(spark.readStream.schema(stream.schema).parquet(closing)))
    last = spark.range(1).select(*[(F.lit(FAR) if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema])
    for closes in (False, True):
        if closes:
            last.write.mode("append").parquet(closing)
        shaped.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(shaped.schema).parquet(out)
