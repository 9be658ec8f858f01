"""Verification of traces: one CASE over the kinds, staged so that code runs only for what the cheap tests leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import text as X
from tracemill.operators.code import parses, run_tests
from tracemill.sources.settings import Settings


def verdict(cfg: Settings) -> Column:
    """struct(ok, why) of a trace, for all kinds but code and code_free, whose ok is null (still open)."""
    kind, answer, gold = F.col("kind"), F.col("answer"), F.col("gold")
    make = lambda ok, why: F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), (why if isinstance(why, Column) else F.lit(why)).alias("why"))
    open_ = F.struct(F.lit(None).cast("boolean").alias("ok"), F.lit("code").alias("why"))
    got = X.final_letter(answer)
    mcq = X.let(got, lambda g: make(g == gold["letter"], F.concat(F.lit("mcq:"), F.coalesce(g, F.lit("None")), F.lit("->"), F.coalesce(gold["letter"], F.lit("None")))))
    out = F.when(X.strip(F.coalesce(answer, F.lit(""))) == "", make(F.lit(False), "empty"))
    if cfg.verify_mcq:
        out = out.when(kind == "mcq", mcq)
    out = out.when(kind == "unanswerable", make(X.abstains(answer), "abstain")).when(kind == "hedge", make(X.declines(answer), "hedge"))
    if cfg.verify_mcq:
        out = out.when(kind == "tf", make(X.true_false_match(answer, gold["letter"]), F.concat(F.lit("tf:"), F.substring(F.lower(F.coalesce(X.final_answer(answer), F.lit(""))), 1, 12))))
    if cfg.verify_qa:
        out = out.when(kind == "qa", make(X.qa_match(answer, gold["aliases"]), "qa"))
    if cfg.verify_code:
        out = out.when(kind.isin("code", "code_free"), open_)
    return out.otherwise(make(F.lit(True), "unverified"))


def verified(traces: DataFrame, cfg: Settings, run_code: bool = False) -> DataFrame:
    """traces with ok and why. Code is parsed, and run only if run_code; otherwise code with tests stays unverified (ok false, why 'code:not run')."""
    judged = traces.withColumn("__v", verdict(cfg)).withColumn("ok", F.col("__v.ok")).withColumn("why", F.col("__v.why")).drop("__v")
    done = judged.where(F.col("ok").isNotNull())
    left = judged.where(F.col("ok").isNull())
    free = left.where("kind = 'code_free'").withColumn("ok", parses(F.col("answer"))).withColumn("why", F.lit("code_free:parse"))
    tested = left.where("kind = 'code'")
    if run_code:
        tested = tested.drop("ok", "why").join(run_tests(tested, enabled=True).withColumnRenamed("passed", "ok"), "id")
    else:
        tested = tested.withColumn("ok", F.lit(False)).withColumn("why", F.lit("code:not run"))
    return done.unionByName(free).unionByName(tested)
