"""Evaluation records: summaries, comparisons of runs, and group signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.stats import mcnemar_p, mcnemar_z

FULL = {"mmlu": 1000, "truthfulqa": 817, "humaneval": 164}


def summary(records: DataFrame, *by: str) -> DataFrame:
    """total, correct, accuracy, truncated, forced, forced_correct, seconds; rounded half to even."""
    right = F.count_if("correct")
    return records.groupBy(*by).agg(
        F.count("*").alias("total"),
        right.alias("correct"),
        F.bround(right / F.greatest(F.count("*"), F.lit(1)), 4).alias("accuracy"),
        F.count_if("truncated").alias("truncated"),
        F.count_if("forced").alias("forced"),
        F.count_if(F.col("forced") & F.col("correct")).alias("forced_correct"),
        F.bround(F.sum("seconds"), 1).alias("seconds"),
    )


def running_accuracy(records: DataFrame, by: str, order: str, cells: int | None = None) -> DataFrame:
    """records with the accuracy over the items done so far; order is an integer column.

    The order is cut into equal ranges; what the ranges before hold (a row for
    each group and range) is added to the window within a range, so a long run
    is no single task.
    """
    edge = records.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("n")).first()
    cells = cells or max(256, edge["n"] // 1_000_000)
    width = max(1, -(-(edge["hi"] - edge["lo"] + 1) // cells)) if edge["lo"] is not None else 1
    celled = records.withColumn("__cell", F.floor((F.col(order) - (edge["lo"] or 0)) / width))
    sums = celled.groupBy(F.col(by).alias("__by"), "__cell").agg(F.count("*").alias("n"), F.count_if("correct").alias("c"))
    earlier = Window.partitionBy("__by").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__by", F.col("__cell").alias("__at"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("__c"))
    so_far = Window.partitionBy(by, "__cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = celled.withColumn("__ni", F.count("*").over(so_far)).withColumn("__ci", F.sum(F.col("correct").cast("long")).over(so_far))
    out = inside.join(offsets, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__cell") == F.col("__at")))
    return out.withColumn("running", (F.col("__ci") + F.col("__c")) / (F.col("__ni") + F.col("__n"))).drop("__cell", "__by", "__at", "__n", "__c", "__ni", "__ci")


def regressions(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Items that run a has right and run b wrong, and the other way round: one row of counts."""
    both = a.select(key, F.col("correct").alias("ca")).join(b.select(key, F.col("correct").alias("cb")), key)
    return both.agg(F.count("*").alias("common"), F.count_if(F.col("ca") & ~F.col("cb")).alias("lost"), F.count_if(F.col("cb") & ~F.col("ca")).alias("gained"))


def outcome(correct: Column, truncated: Column) -> Column:
    """C right, T truncated and not right, W wrong."""
    return F.when(correct, "C").when(truncated, "T").otherwise("W")


def transitions(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    of = lambda df, name: df.select(key, outcome(F.col("correct"), F.col("truncated")).alias(name))
    return of(a, "was").join(of(b, "now"), key).groupBy("was", "now").agg(F.count("*").alias("n"))


def against(rows: DataFrame, run: str, anchor: str, by: str, value: str, ratio: bool = False) -> DataFrame:
    """rows with the difference (or ratio) of value to the anchor run's at the same `by`."""
    base = rows.where(F.col(run) == anchor).select(by, F.col(value).alias("base"))
    joined = rows.join(base, by)
    out = F.col(value) / F.col("base") if ratio else F.col(value) - F.col("base")
    return joined.withColumn("ratio" if ratio else "delta", out)


def recovery(with_help: Column, plain: Column, truncated: Column) -> Column:
    """Share of the truncated items that help recovers."""
    return (with_help - plain) / F.greatest(truncated, F.lit(1))


def two_standard_errors(p1: Column, n1: Column, p2: Column, n2: Column) -> Column:
    return 2 * F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)


def tested(counts: DataFrame) -> DataFrame:
    """counts(lost, gained, ...) with the exact p-value and z of McNemar's test."""
    return counts.withColumns({"p": mcnemar_p(F.col("lost"), F.col("gained")), "z": mcnemar_z(F.col("lost"), F.col("gained"))})


def compared(records: DataFrame, item: str, order: str, *by: str, run: str = "run") -> DataFrame:
    """Every two runs against one another, by group: (*by, a, b, common, lost, gained), a before b by name.

    Of an item's records in a run the last counts. The runs of an item are
    paired where they lie, so records are shuffled once, and pairs are counted
    before they are shuffled; an item has a row for each pair of its runs.
    """
    last = records.groupBy(*by, item, run).agg(F.max_by("correct", order).alias("correct"))
    runs = last.groupBy(*by, item).agg(F.array_sort(F.collect_list(F.struct(F.col(run).alias("run"), "correct"))).alias("__runs"))
    pairs = F.transform("__runs", lambda x, i: F.transform(F.slice("__runs", i + 2, F.size("__runs")), lambda y: F.struct(x["run"].alias("a"), y["run"].alias("b"), x["correct"].alias("was"), y["correct"].alias("now"))))
    each = runs.select(*by, F.explode(F.flatten(pairs)).alias("p")).select(*by, "p.*")
    return each.groupBy(*by, "a", "b").agg(F.count("*").alias("common"), F.count_if(F.col("was") & ~F.col("now")).alias("lost"), F.count_if(F.col("now") & ~F.col("was")).alias("gained"))


def group_flags(samples: DataFrame, key: str) -> DataFrame:
    """By prompt: mixed, mixed_trunc, all_fail, all_pass."""
    g = samples.groupBy(key).agg(F.bool_or("correct").alias("any_c"), F.bool_and("correct").alias("all_c"), F.bool_or("truncated").alias("any_t"))
    return g.select(key, (F.col("any_c") & ~F.col("all_c")).alias("mixed"), (F.col("any_c") & F.col("any_t")).alias("mixed_trunc"), (~F.col("any_c")).alias("all_fail"), F.col("all_c").alias("all_pass"))


def group_signal(samples: DataFrame, key: str) -> DataFrame:
    """One row: number of prompts and of each kind of group."""
    return group_flags(samples, key).agg(F.count("*").alias("prompts"), *[F.count_if(c).alias(c) for c in ("mixed", "mixed_trunc", "all_fail", "all_pass")])


def inconsistent(rows: DataFrame) -> DataFrame:
    """Published rows whose accuracy isn't correct / total."""
    return rows.where(F.abs(F.col("correct") / F.col("total") - F.col("accuracy")) >= 0.001)


def stratified_gap(records: DataFrame, run: str, stratum: str) -> DataFrame:
    """By run: accuracy inside and outside the stratum, and the gap."""
    c = F.col("correct").cast("double")
    inside, outside = F.avg(F.when(F.col(stratum), c)), F.avg(F.when(~F.col(stratum), c))
    return records.groupBy(run).agg(inside.alias("inside"), outside.alias("outside"), (inside - outside).alias("gap"))


def wide(summaries: DataFrame, run: str, benchmarks: list[str]) -> DataFrame:
    """Runs by benchmarks, holding accuracies."""
    return summaries.groupBy(run).pivot("benchmark", benchmarks).agg(F.first("accuracy"))


def with_baseline(baseline: DataFrame, runs: DataFrame) -> DataFrame:
    """Published results and own runs as one long table; runs carry a mark in their name."""
    return baseline.unionByName(runs.withColumn("model", F.concat("model", F.lit(" (this run)"))), allowMissingColumns=True)


def paired(rows: DataFrame, keys: list[str], mode: str, value: str, modes: list[str]) -> DataFrame:
    """One column of `value` for each mode (plain, forced, ramp, ...) at equal keys; null where a mode is missing."""
    return rows.groupBy(*keys).pivot(mode, modes).agg(F.first(value))


def truncation(records: DataFrame, by: str) -> DataFrame:
    """By run: share truncated and right, in points, and mean tokens."""
    return records.groupBy(by).agg((100 * F.count_if("truncated") / F.count("*")).alias("truncated_pct"), (100 * F.count_if("correct") / F.count("*")).alias("correct_pct"), F.avg("tokens").alias("mean_tokens"))


def progress(records: DataFrame, by: str, seconds: str) -> DataFrame:
    """By run: done, seconds, and the rate of seconds a record."""
    done, spent = F.count("*"), F.coalesce(F.sum(seconds), F.lit(0.0))
    return records.groupBy(by).agg(done.alias("done"), spent.alias("seconds"), (spent / F.greatest(done, F.lit(1))).alias("rate"))


def full_runs(summaries: DataFrame, run: str, least: int = 100) -> DataFrame:
    """Runs that aren't sanity checks by name and have a benchmark of `least` items or more, with their largest."""
    return summaries.where(~F.col(run).like("%sanity%")).groupBy(run).agg(F.max("total").alias("largest")).where(F.col("largest") >= least)


def keep_rate(kept: Column, seen: Column) -> Column:
    return kept / F.greatest(seen, F.lit(1))
