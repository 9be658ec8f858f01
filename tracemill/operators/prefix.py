"""Running sums over a whole table in the order of a key, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.session import Scratch

RANGE = 1_000_000  # rows in a range, about


def exclusive_sums(rows: DataFrame, order: list[str], amount: str, into: str, keep: Scratch, rows_a_range: int = RANGE) -> DataFrame:
    """rows with `into`, the sum of `amount` over all rows before in the order of the columns `order` (no two rows equal in all of them).

    Rows are dealt into ranges of the order and stored, so that a range is the
    same in every later step; sums within a range come from a window, and the
    sums of the ranges before it (a row for each range) are added.
    """
    ranges = -(-max(1, rows.count()) // rows_a_range)
    ranged = keep(rows.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()), "prefix-ranges")
    before, shifts = 0, []
    for r in sorted(ranged.groupBy("__range").agg(F.sum(amount).alias("n")).collect()):  # a row for each range
        shifts.append((r["__range"], before))
        before += r["n"] or 0
    shift = rows.sparkSession.createDataFrame(shifts, "__range int, __before long")
    earlier = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(amount).over(earlier), F.lit(0))
    return ranged.withColumn(into, inside).join(F.broadcast(shift), "__range").withColumn(into, (F.col(into) + F.col("__before")).cast("long")).select(*rows.columns, into)
