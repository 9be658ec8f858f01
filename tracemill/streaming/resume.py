"""Append-only logs as streams: drop repeated ids within a bounded time, keep running accuracy, count by windows of event time, and write every batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.sources.commits import DIGITS, Log


def records(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1000, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(folder)


def first_seen(stream: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """Each key once; state is dropped for keys older than the watermark."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def running(stream: DataFrame, by: str, correct: str = "correct") -> DataFrame:
    """Items and accuracy so far by group."""
    return stream.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def sink(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append", once: bool = True) -> StreamingQuery:
    """Hand every batch to write(batch, number). Batch numbers repeat after a restart, so write must overwrite by number or upsert."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w).start()


def logged(stream: DataFrame, checkpoint: str, log: Log, mode: str = "append", once: bool = True) -> StreamingQuery:
    """Commit every batch to a log, under its number and the query's id, which the checkpoint keeps: a batch that runs again after a crash is committed already, or its torn rows never count. It is computed in either case, since the state of an aggregate moves on by that."""

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not log.append(batch, f"{number:0{DIGITS}d}-{query}"):
            batch.write.format("noop").mode("overwrite").save()

    return sink(stream, checkpoint, write, mode, once)


def tumbling(stream: DataFrame, time: str, width: str, late: str, *by: str, value: str) -> DataFrame:
    """Rows and sum of value by window of event time and group, so far. A window whose end the watermark has passed takes no more rows, and its state goes."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return windows.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, gap: str, late: str, *by: str) -> DataFrame:
    """Rows of a group less than a gap apart are a session; it is given out once, when the watermark has passed its end."""
    merged = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return merged.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
