"""Ragged rows as flat parts and offsets: the values of all samples one after another, and where each sample begins and ends.

A flat row knows its place among all, not its sample; the offsets are an
exclusive prefix sum of the samples' lengths. Reading puts both together again
by a look back within bounded stretches of places: no list of parts, and no
sample, is held by a task as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators.prefix import exclusive_sums
from tracemill.session import Scratch

STRETCH = 1 << 16  # places that are put together by one window


def offsets(rows: DataFrame, keep: Scratch) -> DataFrame:
    """rows(sample, pos, ...) -> (sample, lo, hi): a sample's places are lo to hi - 1. Positions must count from 0 without gaps."""
    found = rows.groupBy("sample").agg(F.count("*").alias("n"), F.min("pos").alias("least"), F.max("pos").alias("most"), F.sum(F.col("pos").cast("long")).alias("total"))
    gapless = (F.col("least") == 0) & (F.col("most") == F.col("n") - 1) & (F.col("total") == F.expr("n * (n - 1) div 2"))
    checked = found.select("sample", F.when(gapless, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("positions of sample "), F.col("sample").cast("string"), F.lit(" have gaps or repeat"))).cast("long")).alias("n"))
    return exclusive_sums(checked, ["sample"], "n", "lo", keep).select("sample", "lo", (F.col("lo") + F.col("n")).alias("hi"))


def write(rows: DataFrame, path: str, parts: int | None = None) -> None:
    """rows(sample, pos, values...) as <path>/flat, in order of place, and <path>/offsets. A sample that fills the table is spread over as many parts as its rows need."""
    with Scratch() as keep:
        found = keep(offsets(rows, keep), "ragged-offsets")
        flat = rows.join(found.select("sample", "lo"), "sample").withColumn("place", F.col("lo") + F.col("pos")).drop("sample", "pos", "lo")
        dealt = flat.repartitionByRange(parts, "place") if parts else flat.repartitionByRange("place")
        dealt.sortWithinPartitions("place").write.parquet(f"{path}/flat")
        found.write.parquet(f"{path}/offsets")


def joined(flat: DataFrame, found: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """flat(place, values...) and offsets(sample, lo, hi) -> (sample, pos, values...).

    A sample is named at its first place in every stretch that it touches; a
    flat row belongs to the sample that was named last before it in its stretch.
    """
    values = [c for c in flat.columns if c != "place"]
    touched = F.sequence(F.floor(F.col("lo") / stretch), F.floor((F.col("hi") - 1) / stretch))
    named = found.where("hi > lo").select(F.explode(touched).alias("__stretch"), F.struct("sample", "lo").alias("__of")).withColumn("place", F.greatest(F.col("__of.lo"), F.col("__stretch") * stretch)).withColumn("__row", F.lit(False))
    rows = flat.withColumn("__stretch", F.floor(F.col("place") / stretch)).withColumn("__row", F.lit(True))
    both = rows.unionByName(named, allowMissingColumns=True)
    back = Window.partitionBy("__stretch").orderBy("place", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owned = both.withColumn("__of", F.last("__of", ignorenulls=True).over(back)).where("__row")
    return owned.select("__of.sample", (F.col("place") - F.col("__of.lo")).cast("int").alias("pos"), *values)


def read(spark: SparkSession, path: str) -> DataFrame:
    return joined(spark.read.parquet(f"{path}/flat"), spark.read.parquet(f"{path}/offsets"))
