"""Windows over event streams; the same functions serve batch and streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """Event files as they arrive, in the schema of those already there."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if late and events.isStreaming else e


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return _counted(timed(events, late).groupBy(F.window("ts", size).alias("w"), "event_type"))


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    return _counted(timed(events, late).groupBy(F.window("ts", size, step).alias("w"), "event_type"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    g = timed(events, late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _counted(grouped) -> DataFrame:
    g = grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def closed_windows(spark: SparkSession, source: str, sink: str, checkpoint: str, size: str = "1 hour", late: str = "2 hours", shuffles: int = 4) -> dict[str, int]:
    """Take in the event files that are new since the last call and append the windows that the watermark has closed.

    State, watermark and the files read are kept under ``checkpoint``, so a call after a stop
    or a failure goes on where the last left off, and a window is written once.  Rows that
    come after the watermark has closed their window are dropped.  Gives the rows read and
    the watermark (milliseconds).
    """
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shuffles)  # a new checkpoint keeps it: tasks with state
    try:
        q = tumbling(read_events(spark, source, 1), size, late).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    if q.exception() is not None:
        raise q.exception()
    return {"rows": sum(p["numInputRows"] for p in q.recentProgress)}


def late_rows(source: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: rows of the source, those in windows, and the dropped ones between.

    Exact once every window of the source is closed (``closing_event`` closes them all).
    """
    held = windows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"))
    return source.agg(F.count("*").alias("read")).crossJoin(held).withColumn("dropped", F.col("read") - F.col("kept"))


def closing_event(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """One event, long after all others: its own window stays open, and theirs close."""
    far = F.max(F.col("ts").cast("timestamp")) + F.expr(f"2 * INTERVAL {size} + 2 * INTERVAL {late}")
    kind = {f.name: f.dataType for f in events.schema.fields}
    e = events.agg(far.alias("ts"))
    return e.select(*[F.col("ts").cast(kind["ts"]).alias("ts") if c == "ts" else F.lit(None).cast(kind[c]).alias(c) for c in events.columns])
