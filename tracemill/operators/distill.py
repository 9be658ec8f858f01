"""The distillation loss by sample or batch: cross entropy on the answer mixed with the divergence from a teacher's top-k.

A step t >= 1 of a sequence predicts its token t from the logits after token
t - 1. Steps from prompt_len to end belong to the answer. The teacher's row at
position p of the answer stands at step prompt_len + p, before the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.arrays import logsumexp, mixed_loss, renormalised
from tracemill.functions.text import let
from tracemill.sources import teacher_topk


def answer_mask(step: Column, prompt_len: Column, end: Column) -> Column:
    return (step >= prompt_len) & (step <= end)


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log p(target) under logits over all tokens."""
    return logsumexp(logits) - F.get(logits, target)


def divergence(teacher_ids: Column, teacher_logprobs: Column, logits: Column) -> Column:
    """KL from the teacher's top-k, renormalised over them, to the student's probabilities of these tokens, which are those over all tokens."""

    def of(z: Column) -> Column:
        each = F.zip_with(renormalised(teacher_logprobs), teacher_ids, lambda t, i: F.exp(t) * (t - (F.get(logits, i) - z)))
        return F.aggregate(each, F.lit(0.0), lambda a, x: a + x)

    return let(logsumexp(logits), of)


def with_teacher(steps: DataFrame, store: DataFrame) -> DataFrame:
    """steps(sample, step, prompt_len, end, ...) with the teacher's ids and logprobs at the answer's positions, and has_teacher."""
    pos = F.when(F.col("step") < F.col("end"), F.col("step") - F.col("prompt_len"))  # before the answer it's negative, which no row has
    return teacher_topk.joined(steps.withColumn("pos", pos.cast("int")), store.select("sample", "pos", "ids", "logprobs")).drop("pos")


def losses(steps: DataFrame, alpha: float, *by: str) -> DataFrame:
    """steps(..., step, logits, target, prompt_len, end, ids, logprobs, has_teacher) -> n_tokens, n_teacher, ce, kl, loss by group.

    Cross entropy is a mean over the answer's steps, the divergence over those
    that the teacher has scored too; without any of the latter it is 0, and
    without any of the former so is the loss.
    """
    here = answer_mask(F.col("step"), F.col("prompt_len"), F.col("end"))
    taught = here & F.col("has_teacher")
    ce = F.when(here, cross_entropy(F.col("logits"), F.col("target")))
    kl = F.when(taught, divergence(F.col("ids"), F.transform("logprobs", lambda x: x.cast("double")), F.col("logits")))
    sums = steps.select(*by, here.alias("here"), taught.alias("taught"), ce.alias("ce"), kl.alias("kl")).groupBy(*by).agg(F.count_if("here").alias("n_tokens"), F.count_if("taught").alias("n_teacher"), F.coalesce(F.avg("ce"), F.lit(0.0)).alias("ce"), F.coalesce(F.avg("kl"), F.lit(0.0)).alias("kl"))
    return sums.withColumn("loss", mixed_loss(alpha, F.col("ce"), F.col("kl"), F.col("n_tokens") > 0))
