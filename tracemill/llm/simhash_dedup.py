"""SimHash near-dedup with pigeonring filtering.

The 64 fingerprint bits form a ring of `segments` consecutive segments. If two
fingerprints differ in at most t bits, some start exists from which, for every
length l, the first l segments together differ in at most floor(l * t / m)
bits (pigeonring principle). The leading lengths with budget zero make an
equi-join key of several consecutive segments; the rest of the chain is
checked on each joined pair before the full Hamming distance.

A key that very many fingerprints share is not joined pairwise. Its members
are linked through midpoints instead: two fingerprints are within two bits of
one another exactly if they share a value within one bit of both, so each
member emits itself and its 64 one-bit neighbours, and every such value links
its members to the smallest. That is exact and linear (65 rows a member). It
is defined for t = 2 (and applied for t = 1 with the member itself and a final
distance check left out of play, so t must be 2).

Given cases: null or wordless text has fingerprint zero and is linked like any
other; texts of one or two words are one shingle; repeated rows and equal texts
share a fingerprint; a very long text is hashed in blocks; null ids are kept
and never the smallest; an empty table gives an empty one; near_duplicates()
ignores other columns, keep_first() carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import simhash_shingles
from tracemill.llm.batches import sliced, small_batches
from tracemill.llm.components import components
from tracemill.session import discard, stored

SEED = 42
BLOCK = 1 << 15  # shingles whose bits are spread out at a time


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned 64-bit SimHash of the text's word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: only A-Z change, only ASCII space splits
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        last = ends[lo + width - 1 : hi + width - 1] if len(words) >= width else ends[-1:]
        h = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts[lo:hi], last, strict=True)], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        fps = [_signed(fingerprint(t.as_py())) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_map, "doc_id long, fp long")


def _plan(t: int, m: int) -> tuple[list[int], int, list[tuple[int, int]]]:
    """Segment widths, how many leading segments must be equal, and (length, budget) where the budget is worth a check."""
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    equal = max(n for n in range(1, m) if n * t // m == 0)
    checks = [(n, n * t // m) for n in range(equal + 1, m + 1) if n == m or (n + 1) * t // m > n * t // m]
    return widths, equal, checks


def _turned(x: Column, by: int) -> Column:
    return x if by == 0 else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _links(fps: DataFrame, t: int, m: int, pair_limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """fps(fp), distinct -> (a, b), links that connect all fingerprints within t bits, and the stored tables that they are read from."""
    widths, equal, checks = _plan(t, m)
    at = [0, *accumulate(widths)][:m]
    span = lambda i, n: sum(widths[(i + k) % m] for k in range(n))
    key = lambda i: F.shiftrightunsigned(_turned(F.col("fp"), at[i]), 64 - span(i, equal)).bitwiseOR(F.lit(i << 56))
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), key(i).alias("k")) for i in range(m)])).alias("s")).select("fp", "s.i", "s.k")
    keyed = stored(keyed, "fp-keys")
    hot = stored(keyed.groupBy("k").count().where(F.col("count") > pair_limit).select("k"), "fp-hot")

    few = keyed.join(hot, "k", "left_anti")
    x = F.col("fp").bitwiseXOR(F.col("fp2"))

    def chain(i: int) -> Column:
        ok = F.lit(True)
        for n, budget in checks:
            bits = x if n == m else F.shiftrightunsigned(_turned(x, at[i]), 64 - span(i, n))
            ok = ok & (F.bit_count(bits) <= budget)
        return ok

    fits = F.lit(False)
    for i in range(m):
        fits = fits | ((F.col("i") == i) & chain(i))
    pairs = few.join(few.select(F.col("fp").alias("fp2"), "k"), "k").where(F.col("fp") < F.col("fp2")).where(fits)
    pairs = pairs.where(F.bit_count(x) <= t).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))

    many = keyed.join(hot, "k", "left_semi").select("fp").distinct()
    around = many.select("fp", F.explode(F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)) for b in range(64)])).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("mid"))
    around = stored(around, "fp-mid")
    star = around.join(around.groupBy("mid").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1"), "mid").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    return pairs.union(star), [keyed, hot, around]


def near_duplicates(docs: DataFrame, distance: int = 2, segments: int = 7, pair_limit: int = 256) -> DataFrame:
    """(doc_id, fp, component_id) for every document; component_id is the smallest doc_id reachable over links of at most `distance` bits."""
    if distance != 2:
        raise ValueError("the midpoint form for very common keys is exact for a distance of 2 only")
    each = stored(fingerprints(docs), "fp")
    classes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-class")
    links, made = _links(classes.select("fp"), distance, segments, pair_limit)
    comps = components(links)
    linked = classes.join(comps.toDF("fp", "comp"), "fp")
    lowest = linked.groupBy("comp").agg(F.min("first").alias("component_id"))
    moved = linked.join(lowest, "comp").select("fp", "component_id")
    ids = stored(classes.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "fp-ids")
    for done in (classes, comps, *made):
        discard(done)
    return each.join(ids, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_first(docs: DataFrame, width: int = simhash_shingles.WIDTH, similarity: float = simhash_shingles.SIMILARITY, **params) -> DataFrame:
    """docs with one row of each group, by shingles of `width` words and a similarity of `similarity` or more: the smallest (doc_id, text hash), null ids last, and of rows that repeat it the one with the smallest columns. Candidates are found by pigeonring filtering too, on a fingerprint made for that distance (see simhash_shingles)."""
    return simhash_shingles.keep_first(docs, width=width, similarity=similarity, **params)
