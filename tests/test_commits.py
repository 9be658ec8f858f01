"""Commits that are handed again, torn off or raced; leases that run out; streams that fail and go on."""

import threading
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from tracemill.plans import registry
from tracemill.sources import files
from tracemill.sources.commits import Log
from tracemill.sources.lease import Held, Lease, Lost
from tracemill.streaming import resume

KV = "k string, v int"


def ids(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_commit_counts_once(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", KV, "json")
    a, b = spark.createDataFrame([("a", 1), ("b", 1)], KV), spark.createDataFrame([("b", 2)], KV)
    assert log.read().count() == 0 and log.read("c").columns == ["k", "v", "c"] and log.names() == []
    assert log.append(a, "run-1") and not log.append(b, "run-1")  # whatever its rows are
    torn = log.stage(b, "run-2")
    assert ids(log.read()) == [("a", 1), ("b", 1)]
    assert log.append(b, "run-2") and not log.publish(torn)
    assert ids(log.read("c")) == [("a", 1, "run-1"), ("b", 1, "run-1"), ("b", 2, "run-2")]
    assert ids(log.latest("k")) == [("a", 1), ("b", 2)]
    assert log.sweep() == [] and log.sweep(-60) == [torn] and log.names() == ["run-1", "run-2"] and log.read().count() == 3
    for bad in ("", "../x", "a/b", "~"):
        with pytest.raises(ValueError):
            log.append(a, bad)


def test_commits_without_names_are_numbered(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log", KV)
    for i in range(3):
        log.append(spark.createDataFrame([("k", i), ("k", i - 10)], KV))
    assert log.names() == [f"{i:012d}" for i in range(3)]
    assert ids(log.latest("k", tie=(F.col("v"),))) == [("k", 2)]


def test_one_of_several_writers_wins(spark, tmp_path):
    log, won = Log(spark, f"{tmp_path}/log", KV), []
    folders = [log.stage(spark.createDataFrame([("w", i)], KV), "same") for i in range(6)]
    threads = [threading.Thread(target=lambda f=f: won.append((f, log.publish(f)))) for f in folders]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(x for _, x in won) == 1 and log.read().count() == 1
    assert log.read().first()["v"] == folders.index(next(f for f, x in won if x))


def test_lease(spark, tmp_path):
    now = [1000.0]
    path = f"{tmp_path}/lease"
    first, second = (Lease(spark, path, 100, clock=lambda: now[0]) for _ in range(2))
    with first:
        assert first.check() == 1
        with pytest.raises(Held):
            second.acquire()
        now[0] += 80
        first.renew()
        now[0] += 80
        assert first.check() == 1
        now[0] += 15  # within the margin: the holder stops before others may begin
        with pytest.raises(Lost):
            first.check()
        with pytest.raises(Held):
            second.acquire()
        now[0] += 10  # run out: the second takes over, the first is fenced off
        assert second.acquire().check() == 2
        with pytest.raises(Lost):
            first.check()
        with pytest.raises(Lost):
            first.renew()
        log = Log(spark, f"{tmp_path}/log", KV)
        row = spark.createDataFrame([("a", 1)], KV)
        with pytest.raises(Lost):
            log.append(row, "x", lease=first)
        assert log.read().count() == 0 and log.append(row, "x", lease=second)
    assert second.check() == 2  # the first's release left it alone
    second.release()
    assert Lease(spark, path, 100, clock=lambda: now[0]).acquire().check() == 3


def test_two_writers_want_one_lease(spark, tmp_path):
    got = []

    def take():
        try:
            got.append(Lease(spark, f"{tmp_path}/lease").acquire().number)
        except Held:
            got.append(None)

    threads = [threading.Thread(target=take) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(x or 0 for x in got) == [0, 0, 0, 0, 1]


def test_files(spark, tmp_path):
    at = f"file://{tmp_path}/d/x"
    assert not files.exists(spark, at) and files.names(spark, f"{tmp_path}/d") == []
    assert files.create(spark, at, "one") and not files.create(spark, at, "two") and files.read(spark, at) == "one"
    files.replace(spark, at, "three ü")
    assert files.read(spark, at) == "three ü" and files.names(spark, f"{tmp_path}/d") == ["x"] and abs(files.changed(spark, at) - time.time()) < 60


def test_a_stream_that_fails_after_its_commit(spark, tmp_path):
    """The batch runs again under its number and adds nothing; the state of the aggregate goes on from the checkpoint."""
    src = f"{tmp_path}/in"
    log = Log(spark, f"{tmp_path}/log", "benchmark string, n long, accuracy double")
    rows = lambda lo, hi: spark.range(lo, hi).select(F.lit("b").alias("benchmark"), (F.col("id") % 2 == 0).alias("correct"))

    def start(fail):
        stream = resume.running(resume.records(spark, src, "benchmark string, correct boolean", 1, "parquet"), "benchmark")
        if not fail:
            return resume.logged(stream, f"{tmp_path}/state", log, "update")

        def write(batch, number):
            query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            log.append(batch, f"{number:012d}-{query}")
            if number == 1:
                raise RuntimeError("lost after the commit")

        return resume.sink(stream, f"{tmp_path}/state", write, "update")

    for lo in (0, 10, 20):
        rows(lo, lo + 10).coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="lost after the commit"):
        start(True).awaitTermination()
    assert [x[:12] for x in log.names()] == ["000000000000", "000000000001"]
    start(False).awaitTermination()
    assert [x[:12] for x in log.names()] == ["000000000000", "000000000001", "000000000002"]
    assert ids(log.read().select("n")) == [(10,), (20,), (30,)] and ids(log.latest("benchmark")) == [("b", 30, 0.5)]
    rows(30, 33).coalesce(1).write.mode("append").parquet(src)
    start(False).awaitTermination()
    assert ids(log.latest("benchmark").select("n")) == [(33,)]


def test_sessions_and_late_rows(spark, tmp_path):
    src = f"{tmp_path}/in"
    schema = "ts timestamp, user_id long, value double"
    for part in ([("00:00:00", 1), ("00:04:00", 1), ("00:20:00", 2)], [("01:00:00", 1)], [("02:00:00", 1), ("00:02:00", 1)], [("23:00:00", None)]):
        spark.createDataFrame([(f"2024-01-01 {t}", u, 1.0) for t, u in part], "ts string, user_id long, value double").select(F.col("ts").cast("timestamp"), "user_id", "value").coalesce(1).write.mode("append").parquet(src)
    log = Log(spark, f"{tmp_path}/log", "start timestamp, end timestamp, user_id long, n long")
    resume.logged(resume.sessions(resume.records(spark, src, schema, 1, "parquet"), "ts", "5 minutes", "10 minutes", "user_id"), f"{tmp_path}/state", log).awaitTermination()
    got = sorted((r["user_id"], r["s"], r["e"], r["n"]) for r in log.read().where("user_id is not null").select("user_id", F.date_format("start", "HH:mm").alias("s"), F.date_format("end", "HH:mm").alias("e"), "n").collect())
    assert got == [(1, "00:00", "00:09", 2), (1, "01:00", "01:05", 1), (1, "02:00", "02:05", 1), (2, "00:20", "00:25", 1)]


def as_duckdb_gives(spark, path, name, events):
    """A query over a table of events against its SQL."""
    events.coalesce(1).write.parquet(f"{path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{path}/events.parquet/*.parquet')")
    df = registry.QUERIES[name](spark, str(path))
    want = con.execute(f"select {', '.join(f'"{c}"' for c in df.columns)} from ({registry.ORACLE[name]})").fetchall()
    return sorted(map(tuple, df.collect())), sorted(want)


@pytest.mark.parametrize("name", ["event_sessions", "event_windows"])
def test_width_of_a_slice_that_is_not_whole(spark, tmp_path, name):
    """A tenth of the time of all events is 86400.7 seconds, which the SQL rounds up; an event at the border of the seventh slice is late by that."""
    at = F.when(F.col("id") == 0, 0).when(F.col("id") == 1, 864007).when(F.col("id") == 10, 604810).otherwise(F.col("id") * 7919 % 864000)
    ts = F.timestamp_seconds(at + 1704067200).cast("timestamp_ntz")
    events = spark.range(400).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("a").alias("event_type"), (F.col("id") / 4).alias("value"))
    got, want = as_duckdb_gives(spark, tmp_path, name, events)
    assert got == want


def test_windows_of_events_without_a_type(spark, tmp_path):
    """Every third hour has only events without a type, without a value too in every sixth: the SQL counts them."""
    hour = F.floor(F.col("id") / 3)
    ts = F.timestamp_seconds(hour * 3600 + F.col("id") % 3 * 1000 + 1704067200).cast("timestamp_ntz")
    kind = F.when(hour % 3 > 0, "a")
    events = spark.range(400).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 7).alias("user_id"), kind.alias("event_type"), F.when(hour % 6 > 0, F.col("id") / 4).alias("value"))
    got, want = as_duckdb_gives(spark, tmp_path, "event_windows", events)
    assert got == want and sum(r[1] is None for r in got) == 45


def test_totals_are_rounded_as_the_sql_does(spark, tmp_path):
    """Ties at the seventh digit, totals of more digits than a double times a million holds, and some that are no number."""
    odd = [-136642.9605655, 195159553969.418, -79601374449.209, 1e305, float("inf"), None, 0.0000005, 2.5]
    values = F.array(*[F.lit(x).cast("double") for x in odd])
    ts = F.timestamp_seconds(F.col("id") * 3600 + 1704067200).cast("timestamp_ntz")
    value = F.coalesce(F.get(values, F.col("id").cast("int")), (F.col("id") * 7919 % 1000 * 10000000 + F.col("id") * 104729 * 10 + 5) / 10000000)
    events = spark.range(400).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("a").alias("event_type"), value.alias("value"))
    got, want = as_duckdb_gives(spark, tmp_path, "event_windows", events)
    assert got == want and len(got) > 300


def test_windows_before_1970(spark, tmp_path):
    """Five years, of which two are before a watermark's least."""
    ts = F.timestamp_seconds(F.col("id") * 394201 - 63072000).cast("timestamp_ntz")
    events = spark.range(400).select(F.col("id").alias("event_id"), ts.alias("ts"), (F.col("id") % 7).alias("user_id"), F.lit("a").alias("event_type"), (F.col("id") / 4).alias("value"))
    got, want = as_duckdb_gives(spark, tmp_path, "event_windows", events)
    assert got == want and got[0][0] < "1969"
