"""Incremental scoring and incremental backlog counts."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery


def read_requests(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Stream of scoring requests: JSON lines with one ``features`` text."""
    return (
        spark.readStream.schema("features string")
        .option("maxFilesPerTrigger", files_per_batch)
        .json(folder)
    )


def score_stream(
    stream: DataFrame, model: PipelineModel, sink: str, checkpoint: str, out: str = "predicted_label"
) -> StreamingQuery:
    """Label every waiting request as ``{"features", "prediction"}`` JSON, then stop."""
    scored = model.transform(stream).select("features", F.col(out).alias("prediction"))
    return (
        scored.writeStream.format("json")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def backlog_stream(
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    ts: str = "ts",
    opened: str = "opened",
    closed: str = "closed",
    period: str = "1 day",
) -> StreamingQuery:
    """Count openings and closings per period; the sink gets each period's counts as they change.

    No row is late: there is no watermark, since the state is one row per
    period and so is bounded by the calendar. A batch writes its own folder, so
    a batch that is run again replaces what it wrote before.
    """
    counts = (
        stream.groupBy(F.window(ts, period).alias("w"))
        .agg(F.count_if(F.col(opened)).alias("opened"), F.count_if(F.col(closed)).alias("closed"))
        .select(F.col("w.start").alias("period"), "opened", "closed")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{sink}/part={number}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def finished_backlog(spark: SparkSession, sink: str) -> DataFrame:
    """(period, opened, closed, open): latest counts per period, accumulated.

    Open at a period: all opened up to it less all closed before it.
    """
    latest = (
        spark.read.schema("period timestamp, opened bigint, closed bigint, batch int, part int")
        .parquet(sink)
        .groupBy("period")
        .agg(F.max_by(F.struct("opened", "closed"), "batch").alias("c"))
        .select("period", "c.opened", "c.closed")
    )
    upto = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    return latest.withColumn(
        "open", F.sum("opened").over(upto) - F.coalesce(F.sum("closed").over(before), F.lit(0))
    )
