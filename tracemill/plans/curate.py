"""The curation plan: decontaminate, verify, target, length gate, mix, shuffle, cap, split, pack, statistics.

The reason of every trace is evaluated once and stored, since statistics and
both splits read it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import reason_prefix
from tracemill.operators import chat, sampling
from tracemill.operators.ngrams import contaminated_ids
from tracemill.operators.selection import token_proxy
from tracemill.operators.verify import verified
from tracemill.session import stored
from tracemill.sources.settings import Settings


@dataclass
class Curated:
    reasons: DataFrame
    train: DataFrame
    valid: DataFrame
    stats: DataFrame


def reasons(traces: DataFrame, benchmark: DataFrame | None, cfg: Settings, length: Column | None = None, run_code: bool = False) -> DataFrame:
    """traces with target and reason, tested in the fixed order: contaminated, reject:<why>, no_judgement, too_long, kept."""
    rows = verified(traces, cfg, run_code).withColumn("target", chat.target(cfg.keep_think))
    if benchmark is not None:
        dirty = contaminated_ids(traces.select("id", F.col("prompt").alias("text")), benchmark, cfg.ngram, "id")
        rows = rows.join(dirty.withColumn("dirty", F.lit(True)), "id", "left")
    else:
        rows = rows.withColumn("dirty", F.lit(False))
    size = length if length is not None else token_proxy(F.concat("prompt", "target"))
    reason = (
        F.when(F.coalesce(F.col("dirty"), F.lit(False)), "contaminated")
        .when(~F.col("ok"), F.concat(F.lit("reject:"), reason_prefix(F.col("why"))))
        .when(F.coalesce(F.col("target"), F.lit("")) == "", "reject:no_judgement")
        .when(size > cfg.max_seq_len, "reject:too_long")
        .otherwise("kept")
    )
    return rows.withColumn("reason", reason)


def curate(traces: DataFrame, benchmark: DataFrame | None, cfg: Settings, **params) -> Curated:
    judged = stored(reasons(traces, benchmark, cfg, **params), "reasons")
    mixed = stored(sampling.mix(judged.where("reason = 'kept'"), "domain", "id", cfg.mix, cfg.seed), "mixed")
    if cfg.max_samples:
        mixed = stored(sampling.capped(mixed, "id", cfg.seed, cfg.max_samples).drop("rn"), "capped")
    parts = sampling.split(mixed, "id", cfg.seed, cfg.valid_frac)
    packed = parts.select("part", chat.messages(F.col("prompt"), F.col("target")).alias("messages"))
    seen = judged.groupBy(F.col("reason").alias("key")).agg(F.count("*").alias("n"))
    total = judged.agg(F.lit("seen").alias("key"), F.count("*").alias("n"))
    mixes = mixed.groupBy(F.concat(F.lit("mix:"), F.col("domain")).alias("key")).agg(F.count("*").alias("n"))
    return Curated(judged, packed.where("part = 'train'").drop("part"), packed.where("part = 'valid'").drop("part"), total.union(seen).union(mixes))
