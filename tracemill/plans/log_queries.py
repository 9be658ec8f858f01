"""Queries over growing tables: commits that are handed again or torn off, streams that stop and go on, and windows of event time.

The windows are Structured Streaming's own, beside what the run logs need.
Events are dealt to the triggers of a stream by time, in SLICES equal parts; every
tenth event of a part arrives three parts later, which the watermark is too
late for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.plans.queries import LOG, log, query
from tracemill.session import fresh_path, table
from tracemill.sources import files
from tracemill.sources.commits import DIGITS, Log
from tracemill.streaming import resume

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"
SLICES = 10
STAMP, PRINTED = "%Y-%m-%d %H:%M:%S.%f", "yyyy-MM-dd HH:mm:ss.SSSSSS"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


# ---- commits ------------------------------------------------------------

@query("SELECT event_id, user_id, event_type, value, CAST(event_id % 4 AS INT) AS batch FROM events")
def committed_append(spark, sf):
    """Four batches, of which one is handed again and one was torn off at its first attempt: each row once, with the commit that brought it."""
    rows, path = events(spark, sf), fresh_path(spark, "commits")
    held = Log(spark, path, EVENT)
    for k in range(4):
        batch = rows.where(F.col("event_id") % 4 == k)
        if k == 2:
            held.stage(batch, f"{k:0{DIGITS}d}")  # its writer is lost before it is published
        held.append(batch, f"{k:0{DIGITS}d}")
        if k == 1:
            Log(spark, path, EVENT).append(batch, f"{k:0{DIGITS}d}")  # a writer that doesn't know of the first
    return held.read("commit").select("event_id", "user_id", "event_type", "value", F.col("commit").cast("int").alias("batch"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) = 1")
def committed_upsert(spark, sf):
    """The row of each key that the last commit brought, in three commits without names."""
    rows, held = events(spark, sf), Log(spark, fresh_path(spark, "commits"), EVENT)
    for k in range(3):
        held.append(rows.where(F.col("event_id") % 3 == k))
    return held.latest("user_id", tie=(F.col("event_id"),)).select("user_id", "event_id", "event_type", "value")


# ---- streams ------------------------------------------------------------

@query(f"WITH {LOG} SELECT benchmark, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 9) AS accuracy FROM e GROUP BY benchmark")
def streamed_accuracy(spark, sf):
    """Running accuracy as a stream in update mode, committed batch by batch, over a stop and a restart from its checkpoint; the last commit of each benchmark holds what a batch job gives."""
    rows, src, out = log(spark, sf), fresh_path(spark, "stream-in"), fresh_path(spark, "stream-out")
    held = Log(spark, f"{out}/log", "benchmark string, n long, accuracy double")
    for half in ((0, 1), (2, 3)):
        rows.where((F.col("event_id") % 4).isin(*half)).repartition(2).write.mode("append").parquet(src)
        arrived = len([x for x in files.names(spark, src) if x.startswith("part-")])
        stream = resume.records(spark, src, rows.schema, files_per_trigger=max(1, arrived // (2 + half[0])), fmt="parquet")
        resume.logged(resume.running(stream, "benchmark"), f"{out}/state", held, "update").awaitTermination()
    return held.latest("benchmark").select("benchmark", "n", F.round("accuracy", 9).alias("accuracy"))


def slice_width(lo: int, hi: int) -> int:
    """Seconds of a slice: `//` of doubles divides in full in the SQL, and its cast rounds half to even."""
    return round((hi - lo) / SLICES) + 1


def arrivals(spark: SparkSession, sf: str, rows_a_file: int = 1_000_000) -> tuple[str, int, int]:
    """Events written slice by slice into a folder, each slice that has any as equally many files: the path, the seconds of a slice, and its files. The last file has one event long after all others, which closes what is open; it alone is marked as `closes`."""
    rows, src = events(spark, sf), fresh_path(spark, "arrivals")
    edge = rows.agg(F.unix_seconds(F.min("ts")).alias("lo"), F.unix_seconds(F.max("ts")).alias("hi")).first()
    lo, width = edge["lo"] or 0, slice_width(edge["lo"] or 0, edge["hi"] or 0)
    part = F.floor((F.unix_seconds("ts") - lo) / width)
    arrives = F.when((F.col("event_id") % 10 == 0) & (part + 3 < SLICES), part + 3).otherwise(part)
    placed = rows.withColumn("arrives", arrives)
    counts = {r["arrives"]: r["n"] for r in placed.where("arrives is not null").groupBy("arrives").agg(F.count("*").alias("n")).collect()}  # a row for each slice
    per_slice = min(counts.values(), default=0) // rows_a_file + 1  # in the smallest no file stays empty, which wouldn't be written
    for k in sorted(counts):
        placed.where(F.col("arrives") == k).drop("arrives").withColumn("closes", F.lit(False)).repartition(per_slice).write.mode("append").parquet(src)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_seconds(F.lit(lo + 30 * width)).alias("ts"), F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(0.0).alias("value"), F.lit(True).alias("closes"))
    end.write.mode("append").parquet(src)
    return src, width, per_slice


#: An event is late if its window ends at or before the watermark: the largest time of the slices two and more before the one it arrives with, less a quarter of a slice.
ARRIVED = f"""edge AS (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS lo, CAST((floor(epoch(max(ts))) - floor(epoch(min(ts)))) // {SLICES} AS BIGINT) + 1 AS width FROM events),
    p AS (SELECT e.*, width, CAST(floor((floor(epoch(ts)) - lo) / width) AS BIGINT) AS part FROM events e, edge),
    a AS (SELECT *, CASE WHEN event_id % 10 = 0 AND part + 3 < {SLICES} THEN part + 3 ELSE part END AS arrives FROM p),
    m AS (SELECT arrives, max(max(ts)) OVER (ORDER BY arrives ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS seen FROM a GROUP BY arrives),
    r AS (SELECT a.*, seen - to_seconds(width // 4) AS mark FROM a JOIN m USING (arrives))"""


#: Hours between the events' times and the stream's, 2,000 years: a watermark doesn't go below 1970, so windows that end before would all be late.
AHEAD = 2000 * 8766


def moved(time: str, hours: int) -> Column:
    return F.timestamp_micros(F.unix_micros(time) + hours * 3_600_000_000).alias(time)


def as_sql_rounds(x: Column, places: int) -> Column:
    """round() of doubles as the SQL has it: the product is rounded, half away from zero; Spark rounds the decimal digits, which at a tie is another number."""
    product = x * 10.0**places
    return F.when(F.abs(product) < float("inf"), F.round(product) / 10.0**places).otherwise(x)


@query(f"""WITH {ARRIVED} SELECT strftime(date_trunc('hour', ts), '{STAMP}') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM r
    WHERE mark IS NULL OR date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY ALL""")
def event_windows(spark, sf):
    """Hourly counts by type while events arrive out of order; what comes after the watermark has passed its hour isn't counted."""
    src, width, per_slice = arrivals(spark, sf)
    out = fresh_path(spark, "windows")
    held = Log(spark, f"{out}/log", "start timestamp, event_type string, n long, total double")
    stream = resume.records(spark, src, f"{EVENT}, closes boolean", files_per_trigger=per_slice, fmt="parquet").where("not closes")  # events without a type are counted, as a type of their own
    hours = resume.tumbling(stream.withColumn("ts", moved("ts", AHEAD)), "ts", "1 hour", f"{width // 4} seconds", "event_type", value="value")
    resume.logged(hours.withColumn("start", moved("start", -AHEAD)), f"{out}/state", held, "update").awaitTermination()
    return held.latest("start", "event_type").select(F.date_format("start", PRINTED).alias("start"), "event_type", "n", as_sql_rounds(F.col("total"), 6).alias("total"))


@query(f"""WITH {ARRIVED}, k AS (SELECT *, width // 16 AS gap FROM r WHERE mark IS NULL OR ts + to_seconds(width // 16) > mark),
    s AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + to_seconds(gap) OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS opens FROM k WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM s)
    SELECT user_id, strftime(min(ts), '{STAMP}') AS start, strftime(max(ts) + to_seconds(any_value(gap)), '{STAMP}') AS "end", count(*) AS n FROM g GROUP BY user_id, session""")
def event_sessions(spark, sf):
    """Sessions of each user, given out once when the watermark has passed them; late events open none."""
    src, width, per_slice = arrivals(spark, sf)
    out = fresh_path(spark, "sessions")
    held = Log(spark, f"{out}/log", "start timestamp, end timestamp, user_id long, n long")
    stream = resume.records(spark, src, EVENT, files_per_trigger=per_slice, fmt="parquet")
    merged = resume.sessions(stream, "ts", f"{width // 16} seconds", f"{width // 4} seconds", "user_id")
    resume.logged(merged, f"{out}/state", held).awaitTermination()
    return held.read().where("user_id is not null").select("user_id", F.date_format("start", PRINTED).alias("start"), F.date_format("end", PRINTED).alias("end"), "n")
