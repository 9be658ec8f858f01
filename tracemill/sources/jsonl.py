"""JSON-lines files at the edges: scans with declared schemas, sinks, and upserts. Appends that must survive being handed again go through commits.Log."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators.prefix import exclusive_sums
from tracemill.session import Scratch, stored


def scan(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Records of one or more files or folders; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def scan_ordered(spark: SparkSession, paths: list[str], schema: str, by_time: bool = False, keep: Scratch | None = None) -> DataFrame:
    """As scan(), with file_order (from 0), line_no in the file and number over all files (from 0, blank lines counted), which first-wins and last-wins rules need.

    Files are in the order of `paths`, and within a folder in that of their
    names, or of their times if by_time (what a later run appends comes after).
    The lines are scanned once and stored, as long as `keep` lives (without it,
    for good), so a line's number comes from the scan that read it. A large file
    is read in several blocks: a line's number is its place in its block and the
    lines of the blocks before, which are summed up over a row for each block.
    """
    meta = [F.col(f"_metadata.{c}").alias(c) for c in ("file_path", "file_modification_time", "file_block_start")]
    scans = [spark.read.text(path).select(F.lit(order).alias("path_order"), *meta, F.monotonically_increasing_id().alias("id"), "value") for order, path in enumerate(paths)]
    store = keep or stored
    lines = store(reduce(DataFrame.unionByName, scans), "lines")
    file = ["path_order", *(["file_modification_time"] if by_time else []), "file_path"]
    block = [*file, "file_block_start"]
    blocks = lines.groupBy(*block).agg(F.min("id").alias("lo"), F.count("*").alias("n"))
    with Scratch() as own:
        summed = store(exclusive_sums(blocks, block, "n", "before", own), "line-blocks")
    # files are fewer than blocks; each gets its place among all, and the lines before it
    first = summed.groupBy(*file).agg(F.min("before").alias("start")).withColumn("one", F.lit(1))
    with Scratch() as own:
        files = store(exclusive_sums(first, file, "one", "file_order", own), "line-files")
    where = summed.join(files.select(*file, "start", "file_order"), file)
    numbered = lines.join(where, block).withColumn("number", F.col("before") + F.col("id") - F.col("lo")).where(F.trim("value") != "")
    return numbered.select(F.from_json("value", schema).alias("r"), "file_order", (F.col("number") - F.col("start")).alias("line_no"), "number").select("r.*", "file_order", "line_no", "number")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def merged(*tables: DataFrame) -> DataFrame:
    """Bag union of sources whose columns may differ."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def write_stats(stats: DataFrame, path: str) -> dict[str, int]:
    """A counter table (key, n) as one JSON object; counters are few by design. The file system is the session's, so the path may be on a cluster's."""
    found = {r["key"]: r["n"] for r in stats.orderBy("key").collect()}
    spark = stats.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(json.dumps(found, indent=2).encode()))
    out.close()
    return found


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; the new one wins."""
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc("__age"))
    return both.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__age", "__rn")


def results(spark: SparkSession, path: str) -> DataFrame:
    """A results document, models{name{benchmark{accuracy, correct, total, seconds}}}, as a long table."""
    one = "struct<accuracy:double,correct:int,total:int,seconds:double>"
    doc = spark.read.option("multiLine", True).schema("models map<string,map<string,string>>").json(path)
    cells = doc.select(F.explode("models").alias("model", "b")).select("model", F.explode("b").alias("benchmark", "cell"))
    return cells.select("model", "benchmark", F.from_json("cell", one).alias("r")).select("model", "benchmark", "r.*").where("accuracy is not null")
