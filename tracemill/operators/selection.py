"""Choosing rows: first and last wins, resume, triage, harvest, preference pairs, re-asks, batches, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.text import strip_force
from tracemill.operators import chat
from tracemill.operators.generate import retried, retry_budget  # noqa: F401  part of choosing rows
from tracemill.operators.ngrams import contaminated_ids
from tracemill.operators.sampling import draw, group_ranks
from tracemill.operators.verify import verified
from tracemill.sources.prompts import reask
from tracemill.sources.settings import Settings


def one_per_key(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key in the given order; orders descending give last wins."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def todo(prompts: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Resume: what has no output yet."""
    return prompts.join(done.select(key), key, "left_anti")


def triage(rollouts: DataFrame, kind: str = "kind") -> DataFrame:
    """By kind: n, wrong, truncated, accuracy."""
    wrong = F.count_if(~F.col("correct"))
    return rollouts.groupBy(kind).agg(F.count("*").alias("n"), wrong.alias("wrong"), F.count_if("truncated").alias("truncated"), (1 - wrong / F.greatest(F.count("*"), F.lit(1))).alias("accuracy"))


def failure_arm(pool: DataFrame, rollouts: DataFrame, key: str = "id") -> DataFrame:
    """Prompts of the failed rollouts; a failed id missing in the pool is an error. The rollouts' order is in line_no if they have it."""
    failed = rollouts.where(~F.col("correct")).select(key, *[c for c in ("line_no",) if c in rollouts.columns])
    if failed.join(pool.select(key), key, "left_anti").limit(1).count():
        raise KeyError("failed rollouts without a prompt")
    return failed.join(pool, key)


def control_arm(rollouts: DataFrame, size: int, seed: int, key: str = "id") -> DataFrame:
    """As many ids as there are failures, drawn from all that were rolled (so they may overlap)."""
    return group_ranks(rollouts.select(key), key, seed).where(F.col("rn") <= size).select(key)


def harvest_stats(rollouts: DataFrame, keep_forced: bool = True, kind: str = "kind") -> DataFrame:
    """By kind: n, natural, forced, dropped_forced."""
    right, forced = F.col("correct"), F.coalesce(F.col("forced"), F.lit(False))
    return rollouts.groupBy(kind).agg(
        F.count("*").alias("n"),
        F.count_if(right & ~forced).alias("natural"),
        F.count_if(right & forced & F.lit(keep_forced)).alias("forced"),
        F.count_if(right & forced & F.lit(not keep_forced)).alias("dropped_forced"),
    )


def harvest(pool: DataFrame, rollouts: DataFrame, keep_forced: bool = True) -> DataFrame:
    """Right rollouts as training traces, with the forcing sentence taken out of the thought."""
    forced = F.coalesce(F.col("forced"), F.lit(False))
    kept = rollouts.where(F.col("correct") & (F.lit(keep_forced) | ~forced))
    if kept.join(pool.select("id"), "id", "left_anti").limit(1).count():
        raise KeyError("kept rollouts without a prompt")
    think = strip_force(F.col("think"), chat.FORCE_SENTENCE)
    rows = kept.select("id", think.alias("think"), "answer", forced.alias("forced"), F.lit("self").alias("source"))
    return pool.drop("think", "answer", "forced", "source").join(rows, "id")


def pair_reasons(teacher: DataFrame, rollouts: DataFrame, benchmark: DataFrame | None, cfg: Settings, tokens: Column | None = None, run_code: bool = False) -> DataFrame:
    """Teacher traces with the first-wins rollout and `reason`: no_failure, teacher_unverified, contaminated, chosen_too_long or kept, in this order of tests."""
    order = [c for c in ("file_order", "line_no") if c in rollouts.columns] or [F.lit(0)]
    rolls = one_per_key(rollouts, "id", *order).select("id", F.struct("correct", "truncated", "forced", "think", "answer").alias("roll"))
    rows = verified(teacher, cfg, run_code).join(rolls, "id", "left").withColumn("chosen", chat.target(cfg.keep_think))
    if benchmark is not None:
        prompts = rows.select(F.col("id"), F.col("prompt").alias("text"))
        rows = rows.join(contaminated_ids(prompts, benchmark, cfg.ngram, "id").withColumn("dirty", F.lit(True)), "id", "left")
    else:
        rows = rows.withColumn("dirty", F.lit(False))
    length = tokens if tokens is not None else token_proxy(F.concat("prompt", "chosen"))
    reason = (
        F.when(F.col("roll").isNull() | F.col("roll.correct"), "no_failure")
        .when((F.coalesce(F.col("answer"), F.lit("")) == "") | ~F.col("ok"), "teacher_unverified")
        .when(F.coalesce(F.col("dirty"), F.lit(False)), "contaminated")
        .when(length > cfg.max_seq_len, "chosen_too_long")
        .otherwise("kept")
    )
    cut = F.coalesce(F.col("roll.truncated"), F.lit(False)) | F.coalesce(F.col("roll.forced"), F.lit(False))
    bad = chat.rejected(F.col("roll.think"), F.col("roll.answer"), F.col("roll.truncated"), F.col("roll.forced"))
    return rows.withColumn("reason", reason).withColumn("rejected", bad).withColumn("rejected_unterminated", cut)


def pairs(reasons: DataFrame, system: str = chat.EXPERT_SYSTEM) -> DataFrame:
    """Preference records of the rows that were kept."""
    return reasons.where("reason = 'kept'").select(chat.messages(F.col("prompt"), None, system).alias("messages"), "chosen", "rejected", "id", "kind", "rejected_unterminated")


def pair_stats(reasons: DataFrame) -> DataFrame:
    """(key, n): the reasons, kept by kind, and kept with an unterminated rejection."""
    kept = F.col("reason") == "kept"
    keys = F.array_compact(F.array(F.when(~kept, F.col("reason")), F.when(kept, F.concat(F.lit("kept:"), F.col("kind"))), F.when(kept & F.col("rejected_unterminated"), F.lit("kept:unterminated"))))
    return reasons.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def reasks(traces: DataFrame, cfg: Settings, done: DataFrame | None = None) -> DataFrame:
    """Open-ended traces that failed, as prompts that ask about confidence; sources named hedge are left out."""
    failed = verified(traces.where((F.col("kind") == "qa") & (F.coalesce(F.col("source"), F.lit("")) != "hedge")), cfg).where(~F.col("ok"))
    out = failed.withColumn("id", F.concat(F.lit("hedge-"), F.col("id"))).withColumn("kind", F.lit("hedge")).withColumn("ask", reask(F.col("prompt")))
    return todo(out, done) if done is not None else out


def batches(df: DataFrame, group: str, key: str, size: int, seed: int = 17) -> DataFrame:
    """df with the number of its batch within its group, in the seeded order; every batch but a group's last is full."""
    return group_ranks(df, key, seed, group).withColumn("batch", F.floor((F.col("rn") - 1) / size).cast("long")).drop("rn")


def routes(df: DataFrame, teachers: dict[str, list[str]], domain: str) -> DataFrame:
    """df with the first teacher that lists its domain; other rows go."""
    first: dict[str, str] = {}
    for name, domains in teachers.items():
        for d in domains:
            first.setdefault(d, name)
    table = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    return df.withColumn("teacher", F.try_element_at(table, F.col(domain))).where(F.col("teacher").isNotNull())


def token_proxy(text: Column) -> Column:
    """Blank-separated words, where no tokenizer is plugged in."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


def seeded(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(draw(seed, F.col(key)), key)
