"""Error-rate alerts on a stream of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.scale import scratch_path


def read_event_stream(spark: SparkSession, folder: str, schema, *, glob: str = "*.parquet") -> DataFrame:
    """Events as a file stream. Time must be TIMESTAMP: watermarks reject zone-free timestamps."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_errors(
    events: DataFrame, failed: Column, *, width: str, delay: str, slide: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Events and errors per key and window; rows later than ``delay`` behind the newest are dropped.

    ``window`` itself is kept: later steps of the stream take their time from it.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        events.withWatermark("ts", delay)
        .groupBy(window.alias("window"), *by)
        .agg(F.count(F.lit(1)).alias("n_events"), F.count_if(failed).alias("n_errors"))
        .select("window", F.col("window.start").alias("window_start"), *by, "n_events", "n_errors")
    )


def alerting(windows: DataFrame, *, share: float, min_events: int) -> DataFrame:
    """Windows with enough events and a high error share, as in the batch operator."""
    error_share = F.col("n_errors").cast("double") / F.col("n_events")
    return windows.where((F.col("n_events") >= min_events) & (error_share >= F.lit(share))).withColumn(
        "error_share", F.round(error_share, 4)
    )


def alert_runs(alerted: DataFrame, *, step_seconds: int, by: Sequence[str] = ()) -> DataFrame:
    """Alert windows of one key that follow each other, merged into a run while the stream goes on.

    A second stateful step behind the windows: a session over their times. Windows lie ``step_seconds``
    apart, so a session that bridges one and a half steps joins neighbours and nothing else. In append
    mode a run is written once, when the watermark has passed its last window and the bridge; until then
    its state is a row per key, however many windows it has.
    """
    session = F.session_window("_at", f"{step_seconds * 1500} milliseconds")
    return (
        alerted.withColumn("_at", F.window_time("window"))
        .groupBy(session.alias("_session"), *by)
        .agg(
            F.min("window_start").alias("first_detected"),
            F.max("window_start").alias("last_window"),
            F.count(F.lit(1)).alias("n_windows"),
            F.max("error_share").alias("peak_share"),
        )
        .drop("_session")
    )


def run_to_end(stream: DataFrame, label: str, *, mode: str) -> DataFrame:
    """Run a stream over all files there are now and return what it wrote as a table.

    ``complete`` returns the last full result. Each batch has a folder of its own, so a crash while one is
    written leaves the one before it whole. ``append`` writes each row once, after the watermark has passed
    it; the newest windows of a bounded input are therefore missing. Output and checkpoint lie in the
    shared folder, so a restart on other machines goes on from there.
    """
    spark = stream.sparkSession
    target, progress = scratch_path(spark, label), scratch_path(spark, f"{label}-progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True)
    if mode != "complete":
        query = writer.format("parquet").option("path", target).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(target)

    finished = []

    def keep(batch: DataFrame, number: int) -> None:
        # Only a batch that is tried again finds its folder there.
        batch.write.mode("overwrite").parquet(f"{target}/batch-{number}")
        finished.append(number)

    writer.foreachBatch(keep).start().awaitTermination()
    if not finished:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{target}/batch-{max(finished)}")
