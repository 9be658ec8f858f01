"""Importance resampling towards a target distribution by hashed word n-grams.

A document's features are its runs of one to n words, each hashed into a
bucket by the CRC-32 of its bytes. One scan over a document's words feeds a
ring of running CRC states, one for each of the last n starts: a word opens a
state of its own and extends the others by a space and itself, and every state
is the CRC of one feature that ends there. No feature is ever built as a
string, and a text of any length is read in pieces with the ring carried over.

1. The scan over all documents counts the features of every bucket (partitions
   add up their own, a bounded number of rows each), and the same over the
   target's texts.
2. A bucket's gain is the scaled logarithm of the ratio of both smoothed shares.
   The table of gains has one entry a bucket whatever the input, and is broadcast.
3. A second scan sums the gains of every document's features, and a seeded
   Gumbel term makes the order of the sums a draw without replacement.
4. The share that is drawn is ranked overall: rows that can't be drawn are set
   aside by a quantile with a proven error, the others are dealt into ranges of
   the order, ranked inside them, and shifted by the counts of the ranges before.

Given cases: null text has no words, so no features and weight 0; so has an
empty or wordless one. Repeated rows are documents of their own; equal scores
go by doc_id, null ids last, and among equal (score, doc_id) rows the ranks are
given in any order. A null id is drawn as the empty one ("42:"). An empty table
gives an empty result, an empty target a share of 0 in every bucket before
smoothing. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.batches import sliced, small_batches, word_pieces
from tracemill.session import Scratch, stored

BUCKETS, NGRAM, SEED = 10_000, 3, 42
RANGE = 500_000  # candidates in a range of the ranking, about
#: Digits, letters (capitals folded) and all bytes of characters beyond ASCII stay; any other byte ends a word.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ring(words: list[bytes], states: list[int], n: int = NGRAM) -> tuple[list[int], list[int]]:
    """CRC-32 of every run of one to n words that ends in `words`, and the states to go on with. states: the CRCs of the runs that end before, the shortest first."""
    out: list[int] = []
    add = out.extend
    last = n - 1
    for w in words:
        spaced = b" " + w
        states = [crc32(w), *[crc32(spaced, s) for s in states[:last]]]
        add(states)
    return out, states


def _buckets(raw: bytes | None, buckets: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features) of a text, piece by piece."""
    states: list[int] = []
    for words in word_pieces(raw, FOLD):
        found, states = ring(words, states, n)
        yield len(words), np.array(found, np.int64) % buckets


def feature_counts(texts: DataFrame, buckets: int = BUCKETS, n: int = NGRAM) -> np.ndarray:
    """Features of all texts by bucket: one row a bucket and partition is shuffled, one row a bucket collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in sliced(batches, size=4 << 20):
            for raw in part.column(0).to_pylist():
                for _, found in _buckets(raw, buckets, n):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, count in found.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = count
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of add-one shares) of every bucket."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * float(s_all + size)) / (float(s + 1) * float(t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, n: int = NGRAM) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    schema = docs.select("doc_id").schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for part in sliced(batches, size=4 << 20):
            rows = []
            for raw in part.column(1).to_pylist():
                words = features = weight = 0
                for k, found in _buckets(raw, len(gain), n):
                    words, features, weight = words + k, features + len(found), weight + int(gain[found].sum())
                rows.append((words, features, weight))
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def gumbel(seed: int = SEED):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("seed:doc_id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(rows: DataFrame, keep: Scratch, share: int = 5, least: int = 20) -> DataFrame:
    """rows(doc_id, n_words, score, ...) with `rank` for the floor(share * N / 100) best of the N rows with at least `least` words. rows is read several times; what is stored on the way lives as long as `keep`."""
    fits = F.col("n_words") >= least
    n = rows.where(fits).count()
    k = share * n // 100
    if not k:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    # a quantile whose rank is off by at most n / 10,000; a margin of fifty times that, and a count, make sure that the best k lie above
    cut = rows.where(fits).agg(F.percentile_approx("score", max(0.0, 1 - k / n - 0.005), 10_000)).first()[0]
    reach = fits & (F.col("score") >= cut)
    m = rows.where(reach).count()
    if m < k:
        reach, m = fits, n
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranged = keep(rows.where(reach).repartitionByRange(-(-m // RANGE), *order).withColumn("__range", F.spark_partition_id()), "drawn-ranges")
    before, shifts = 0, []
    for r, c in sorted(ranged.groupBy("__range").count().collect()):  # a row for each range
        shifts.append((r, before))
        before += c
    shift = rows.sparkSession.createDataFrame(shifts, "__range int, __before long")
    at = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before")
    ranked = ranged.join(F.broadcast(shift), "__range").withColumn("rank", at)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).select(*rows.columns, "rank")
    return ranked.unionByName(rows.where(~F.coalesce(reach, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: int = 5, least: int = 20, seed: int = SEED, buckets: int = BUCKETS, n: int = NGRAM) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; target has `text`."""
    small_batches(docs.sparkSession)
    gain = gains(feature_counts(docs, buckets, n), feature_counts(target, buckets, n))
    scored = weighed(docs, gain, n).withColumn("score", F.col("weight") + gumbel(seed))
    with Scratch() as keep:
        rows = keep(scored, "importance-scores")
        return stored(drawn(rows, keep, share, least).select("doc_id", "n_features", "weight", "score", "rank"), "importance")
