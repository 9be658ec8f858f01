"""Arithmetic over arrays of logits and log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill.functions.text import let


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def logsumexp(values: Column) -> Column:
    return let(F.array_max(values), lambda m: m + F.log(_sum(F.transform(values, lambda x: F.exp(x - m)))))


def top_logprobs(logits: Column, k: int) -> Column:
    """array<struct(logprob, id)> of the k largest logits, largest first, ties to the smaller id; log-probabilities over all."""
    pairs = F.transform(logits, lambda x, i: F.struct((-x).alias("neg"), i.alias("id")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return let(logsumexp(logits), lambda z: F.transform(best, lambda p: F.struct((-p["neg"] - z).alias("logprob"), p["id"].alias("id"))))


def renormalised(logprobs: Column) -> Column:
    return let(logsumexp(logprobs), lambda z: F.transform(logprobs, lambda x: x - z))


def kl(teacher: Column, student: Column) -> Column:
    """KL of two log-probability arrays over the same k tokens, each renormalised over them."""
    return let(renormalised(teacher), lambda t: let(renormalised(student), lambda s: _sum(F.zip_with(t, s, lambda a, b: F.exp(a) * (a - b)))))


def mixed_loss(alpha: float, cross_entropy: Column, divergence: Column, mask: Column) -> Column:
    """alpha * CE + (1 - alpha) * KL where mask holds, else zero."""
    return F.when(mask, alpha * cross_entropy + (1 - alpha) * divergence).otherwise(F.lit(0.0))


def preference_margin(beta: float, chosen: Column, rejected: Column, chosen_ref: Column, rejected_ref: Column) -> Column:
    return beta * ((chosen - chosen_ref) - (rejected - rejected_ref))


def preference_loss(margin: Column) -> Column:
    return F.log1p(F.exp(-margin))


def pad_bucket(length: Column, cap: int, step: int = 128) -> Column:
    return F.least(F.lit(cap).cast("long"), (F.ceil(length / step) * step).cast("long"))


def ramp_bias(n: Column, start: int, slope: float, is_open: Column) -> Column:
    """Bias towards closing a thought that has gone on for n tokens."""
    return F.when(is_open & (n > start), slope * (n - start)).otherwise(F.lit(0.0))


def aligned(values: Column, prompt_length: Column) -> Column:
    """The part of per-position values that predicts the answer: from the last prompt position on, without the last one."""
    return F.slice(values, F.greatest(prompt_length, F.lit(1)), F.greatest(F.lit(0), F.size(values) - F.greatest(prompt_length, F.lit(1))))
