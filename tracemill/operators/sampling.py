"""Seeded sampling, shuffling, mixing and splitting by md5 order: deterministic, independent of partitions, and without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *parts: Column) -> Column:
    """The sort key of a seeded draw."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def sample_per_group(df: DataFrame, group: str, key: str, seed: int, k: int | Column) -> DataFrame:
    """k rows of each group. One partial top-k per group: the window filter on row_number is pushed below the shuffle as a group limit."""
    order = Window.partitionBy(group).orderBy(draw(seed, F.col(group), F.col(key)), key)
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)


def sample(df: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """k rows of the table (all, if fewer), then in the order of their keys."""
    return df.orderBy(draw(seed, F.col(key)), key).limit(k).orderBy(key)


def group_ranks(df: DataFrame, key: str, seed: int, group: str | None = None) -> DataFrame:
    """df with `rn`, the rank from 1 of every row in the order of the draw, overall or within each group, without bringing a group's rows into one task.

    The draw's leading hex digits cut the order into ranges of at most a million
    rows or so; ranks within a range come from a window, and the row counts of
    the ranges before it (one for each range and group, groups being domains or
    kinds) are added. How many ranges there are doesn't change a rank.
    """
    total, digits = df.count(), 2
    while total > 1_000_000 * 16**digits and digits < 5:
        digits += 1
    parts = [F.col(group)] if group else []
    ranged = df.withColumn("__draw", draw(seed, *parts, F.col(key))).withColumn("__range", F.substring("__draw", 1, digits)).withColumn("__group", F.col(group).cast("string") if group else F.lit(""))
    before: dict = {}
    shifts = []
    for r in sorted(ranged.groupBy("__group", "__range").count().collect(), key=lambda r: (r["__group"] or "", r["__group"] is None, r["__range"])):
        shifts.append((r["__group"], r["__range"], before.get(r["__group"], 0)))
        before[r["__group"]] = before.get(r["__group"], 0) + r["count"]
    table = df.sparkSession.createDataFrame(shifts, "__g string, __r string, __shift long")
    inside = F.row_number().over(Window.partitionBy("__group", "__range").orderBy("__draw", key))
    ranked = ranged.withColumn("__in", inside).join(F.broadcast(table), F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__range") == F.col("__r")))
    return ranked.withColumn("rn", F.col("__in") + F.col("__shift")).drop("__draw", "__range", "__group", "__g", "__r", "__in", "__shift")


def mix_plan(df: DataFrame, domain: str, shares: dict[str, float]) -> DataFrame:
    """(domain, cnt, n): rows to keep of each domain. The scale is that of the most over-supplied domain; domains without a share keep all."""
    table = F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(float(v)))])
    share = F.coalesce(F.try_element_at(table, F.col(domain)), F.lit(0.0))
    counts = df.groupBy(domain).agg(F.count("*").alias("cnt")).withColumn("share", share)
    scale = counts.where("share > 0").agg(F.max(F.col("cnt") / F.col("share")).alias("scale"))
    planned = counts.join(F.broadcast(scale))  # one row
    n = F.when(F.col("share") > 0, F.least(F.col("cnt"), F.floor(F.col("scale") * F.col("share")))).otherwise(F.col("cnt"))
    return planned.select(domain, "cnt", n.cast("long").alias("n"))


def mix(df: DataFrame, domain: str, key: str, shares: dict[str, float], seed: int) -> DataFrame:
    """The planned number of rows of each domain, drawn by md5."""
    plan = mix_plan(df, domain, shares).select(F.col(domain).alias("__d"), "n")
    ranked = group_ranks(df, key, seed, domain)
    return ranked.join(F.broadcast(plan), F.col(domain).eqNullSafe(F.col("__d"))).where("rn <= n").drop("__d", "n", "rn")


def split(df: DataFrame, key: str, seed: int, valid_frac: float) -> DataFrame:
    """df with `part`: valid for the head of the shuffle (at least one row), train for the rest."""
    total = df.count()
    n_valid = max(int(total * valid_frac), 1) if total else 0
    return group_ranks(df, key, seed).withColumn("part", F.when(F.col("rn") <= n_valid, "valid").otherwise("train"))


def capped(df: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """At most `most` rows after the shuffle."""
    return group_ranks(df, key, seed).where(F.col("rn") <= most)
