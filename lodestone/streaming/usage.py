"""Streaming usage accounting over the event log: an extension, with results equal to the batch's.

Results go to a table in the shared folder, batch by batch, never to the driver's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.plans.catalog import query
from lodestone.plans.joins import scratch


def events_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream; its time is made a timestamp, which a watermark asks for."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).parquet(f"{d}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def without_repeats(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Each event id once, as long as its repeats come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def usage_by_window(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Calls and summed value a tumbling window and event type, repeats of an event id dropped."""
    return without_repeats(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """All that is there now, run through the stream: its output rows with `batch`, the number of their micro-batch.

    A batch that is repeated after a failure overwrites its own rows."""
    spark = stream.sparkSession
    path, held = scratch(spark, name), scratch(spark, f"{name}-state")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/b={batch}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", held).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop("b")


@query("stream_usage_tumbling", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _usage(spark: SparkSession, d: str) -> DataFrame:
    """Updates of every window; the last one counts."""
    out = drained(usage_by_window(events_stream(spark, d)), "usage", "update")
    return out.groupBy(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))


@query("stream_dedup_watermark", "SELECT event_id, event_type FROM events")
def _dedup(spark: SparkSession, d: str) -> DataFrame:
    """Every event twice in the stream, once in the result."""
    twice = events_stream(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return drained(without_repeats(twice).select("event_id", "event_type"), "dedup", "append").select("event_id", "event_type")
