"""Structured Streaming forms: running confusion counts, usage windows, sessions, arriving reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.metrics import binary_label, confusion_counts


def as_timestamp(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need a TIMESTAMP; naive ones are taken as UTC (the session's zone)."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def running_confusion(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Confusion counts and failures per key, in update mode."""
    t, p = binary_label(F.col("true_label")), binary_label(F.col("predicted_label"))
    ok = F.coalesce(F.col("is_success"), F.lit(False))
    return predictions.groupBy(*keys).agg(F.count("*").alias("n"), F.sum((~ok).cast("long")).alias("n_failed"), *confusion_counts(F.when(ok, t), F.when(ok, p)))


def usage_windows(events: DataFrame, ts: str, keys: list[str], value: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Count, sum and mean of a value per window (tumbling, or sliding with ``slide``)."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = as_timestamp(events, ts).withWatermark(ts, late).groupBy(w.alias("w"), *keys)
    return g.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total", "mean")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Session windows of a key: begin, end, events."""
    g = as_timestamp(events, ts).withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def arriving_reports(spark: SparkSession, folder: str, schema: str, late: str = "1 day") -> DataFrame:
    """Report files as they arrive, each experiment once within the watermark."""
    r = spark.readStream.schema(schema).option("multiLine", True).option("pathGlobFilter", "benchmark_report_*.json").option("recursiveFileLookup", True).json(folder)
    r = r.select(F.to_timestamp("benchmark_info.timestamp").alias("ts"), F.col("benchmark_info.experiment_name").alias("experiment_name"), F.col("metrics.accuracy").alias("accuracy"), "is_success")
    return r.withWatermark("ts", late).dropDuplicatesWithinWatermark(["experiment_name"])


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, and read what it wrote. For tests and queries: the sink is Parquet in the shared folder."""
    path = f"{folder}/out"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    else:
        q = (
            stream.writeStream.foreachBatch(lambda df, epoch: df.withColumn("_epoch", F.lit(epoch)).write.mode("append").parquet(path))
            .option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
        )
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)
