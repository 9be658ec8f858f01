"""n-gram decontamination in one pass over the texts.

The words of a document are hashed once, and its n-grams from these by pairs
of pairs. Each is looked up in a table of bytes that the benchmark's n-grams
have marked (a Bloom filter with three probes, part of the plan up to a checked
size), until the first that may be known: so only documents that hit leave the
scan, and they are verified on the n-gram strings. A benchmark of more n-grams
is joined by hash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.text import let, tokens

PROBES, SPARSE = 3, 64  # probes of a hash, and bytes for each n-gram
TABLE_BYTES = 1 << 22


def _windows(values: Column, n: int) -> Column:
    """The hash of every n consecutive values, from those of the powers of two that n is made of."""
    none = F.lit(0)

    def joined(parts: list[tuple[int, Column]]) -> Column:
        """The largest first, each from where the ones before it end."""
        at, out = parts[-1]
        for size, level in reversed(parts[:-1]):
            rest = F.slice(level, at + 1, F.greatest(F.size(level) - at, none))
            out = F.zip_with(F.slice(out, 1, F.greatest(F.size(level) - at, none)), rest, lambda x, y: F.xxhash64(x, y))
            at += size
        return out

    def doubled(level: Column, size: int, parts: list[tuple[int, Column]]) -> Column:
        parts = [*parts, (size, level)] if n & size else parts
        if 2 * size > n:
            return joined(parts)
        both = F.zip_with(F.slice(level, 1, F.greatest(F.size(level) - size, none)), F.slice(level, size + 1, F.size(level)), lambda x, y: F.xxhash64(x, y))
        return let(both, lambda x: doubled(x, 2 * size, parts))

    return doubled(values, 1, [])


def gram_hashes(text: Column, n: int) -> Column:
    """Hashes of all n-grams of the text, in order."""
    empty = F.array().cast("array<bigint>")
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    return let(tokens(text), lambda w: F.when(F.size(w) >= n, let(hashed(w), lambda h: _windows(h, n))).otherwise(empty))


def grams(text: Column, n: int) -> Column:
    empty = F.array().cast("array<string>")
    return let(tokens(text), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(empty))


def index(benchmark: DataFrame, n: int, text: str = "text") -> DataFrame:
    """All distinct n-grams of the benchmark; items under n words have none."""
    return benchmark.select(F.explode(grams(F.col(text), n)).alias("gram")).distinct()


def marked(hashes: list[int]) -> bytes:
    """A table with a byte set for each probe of each hash; its size is a power of two."""
    size = 1 << max(16, (SPARSE * max(1, len(hashes)) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    h = np.array(hashes, np.int64).view(np.uint64)
    for k in range(PROBES):
        out[(h >> np.uint64(21 * k)) & np.uint64(size - 1)] = 1
    return out.tobytes()


def _probed(table: bytes) -> Callable[[Column], Column]:
    """A function that says whether a hash has all its probes marked."""
    held, mask = F.lit(bytearray(table)), len(table) - 1
    spot = lambda h, k: F.substring(held, F.shiftrightunsigned(h, 21 * k).bitwiseAND(F.lit(mask)).cast("int") + 1, F.lit(1)) == F.lit(bytearray(b"\x01"))

    def probed(h: Column) -> Column:
        out = spot(h, 0)
        for k in range(1, PROBES):
            out = out & spot(h, k)
        return out

    return probed


def may_hold(hashes: Column, table: bytes) -> Column:
    """Whether one of the hashes has all its probes marked; stops at the first."""
    return F.exists(hashes, _probed(table))


def _hits(rows: DataFrame, benchmark: DataFrame, n: int, key: str, table_bytes: int) -> tuple[DataFrame, bytes | None]:
    """The documents that may share an n-gram with the benchmark, and the table that they were looked up in, if there is one."""
    most = table_bytes // SPARSE
    known = benchmark.select(F.explode(gram_hashes(F.col("text"), n)).alias("h")).distinct()
    first = known.limit(most + 1).collect()  # more than that are never brought here
    if len(first) <= most:
        held = marked([r["h"] for r in first])
        return rows.where(may_hold(gram_hashes(F.col("text"), n), held)), held
    found = rows.select(key, F.explode(gram_hashes(F.col("text"), n)).alias("h")).join(known, "h", "left_semi").select(key).distinct()
    return rows.join(found, key, "left_semi"), None


def contaminated_ids(docs: DataFrame, benchmark: DataFrame, n: int = 13, key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Ids of the documents that share an n-gram with the benchmark."""
    hit, _ = _hits(docs.select(key, "text"), benchmark, n, key, table_bytes)
    return hit.select(key, F.explode(grams(F.col("text"), n)).alias("gram")).join(index(benchmark, n), "gram", "left_semi").select(key).distinct()


def shared(docs: DataFrame, benchmark: DataFrame, n: int = 13, key: str = "doc_id", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The distinct n-grams of the benchmark that some document holds. Of the documents that hit, only the n-grams that the table may hold leave the scan."""
    hit, held = _hits(docs.select(key, "text"), benchmark, n, key, table_bytes)
    found = grams(F.col("text"), n)
    if held:
        probed = _probed(held)
        found = let(gram_hashes(F.col("text"), n), lambda h: F.filter(grams(F.col("text"), n), lambda _, i: probed(F.get(h, i))))
    return hit.select(F.explode(found).alias("gram")).distinct().join(index(benchmark, n), "gram", "left_semi")
