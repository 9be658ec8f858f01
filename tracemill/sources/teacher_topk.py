"""Teacher top-k store: one row per sample and position, appended by sample, joined to training samples with a mask where none exists."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.arrays import top_logprobs
from tracemill.schemas import TOPK


def reduced(logits: DataFrame, k: int = 64) -> DataFrame:
    """logits(sample, pos, values) -> the k largest log-probabilities with their ids."""
    top = top_logprobs(F.col("values"), k)
    return logits.select("sample", "pos", top.alias("t")).select("sample", "pos", F.transform("t", lambda x: x["id"]).alias("ids"), F.transform("t", lambda x: x["logprob"].cast("float")).alias("logprobs"))


def scored(samples: DataFrame, factory: Callable[[], Callable]) -> DataFrame:
    """samples(sample, messages) -> (sample, pos, values): the logits that a scorer gives for the positions of the answer. The scorer is called with one sample's messages and returns a list of lists."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = factory()
        for frame in frames:
            for sample, messages in zip(frame["sample"], frame["messages"], strict=True):
                values = score([dict(m) for m in messages])
                yield pd.DataFrame({"sample": [sample] * len(values), "pos": range(len(values)), "values": [[float(x) for x in row] for row in values]})

    plain = F.transform("messages", lambda m: F.create_map(F.lit("role"), m["role"], F.lit("content"), m["content"]))
    return samples.select("sample", plain.alias("messages")).mapInPandas(run, "sample int, pos int, values array<double>")


def append(rows: DataFrame, path: str) -> None:
    """Partitioned by a hash of the sample, so a resumed run only reads what it has to."""
    rows.withColumn("slice", F.pmod(F.xxhash64("sample"), F.lit(64)).cast("int")).write.mode("append").partitionBy("slice").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{TOPK}, slice int").parquet(path).drop("slice")


def missing(samples: DataFrame, store: DataFrame) -> DataFrame:
    """Samples without rows in the store."""
    return samples.join(store.select("sample").distinct(), "sample", "left_anti")


def joined(positions: DataFrame, store: DataFrame) -> DataFrame:
    """positions(sample, pos, ...) with the teacher's arrays and has_teacher; absent ones are masked, not dropped."""
    return positions.join(store, ["sample", "pos"], "left").withColumn("has_teacher", F.col("ids").isNotNull())


def domains_by_prompt(samples: DataFrame, prompts: DataFrame) -> DataFrame:
    """samples(prompt, ...) with the domain of the prompt of equal text (the last one, if several), others dropped."""
    last = prompts.groupBy("prompt").agg(F.max_by("domain", "id").alias("domain"))
    return samples.drop("domain").join(last, "prompt")
