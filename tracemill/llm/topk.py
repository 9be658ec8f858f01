"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are quantised to integers. Rows are dealt into candidate groups and
queries into query groups, both of bounded size by the tables' own counts; a
cell of the grid sees one group of each. Within a cell, candidates lie in
vertical layout (dimension by row), longest vectors first, and every query
visits the dimensions in falling order of its own mass. After each block of
dimensions a candidate's score can grow by at most the product of the two
vectors' remaining norms (Cauchy-Schwarz); candidates that can't reach the
query's k-th best score so far are compacted away before the next block, and
chunks of candidates that are too short to reach it aren't visited at all. So
that there is a score to reach from the start, the candidates that lead after
the first block of the first chunk are finished first. Bounds are widened by a
relative 1e-5, and only candidates strictly below the k-th score go, so ties
are kept and the result is exact. Each cell returns k rows a query, which one
window merges.

All queries meet all rows, as the task states; the grid replicates queries by
the number of candidate groups and rows by the number of query groups, and
nothing is collected or broadcast.

Given cases: vectors that are null or hold null, NaN or infinite components
take no part; a shorter vector counts as padded with zeros; rows that share
the query's vec_id are its own and no candidates; equal (vec_id, vector) query
rows are one query; a null vec_id is a candidate (last among ties) and no
query; with fewer than k candidates all are returned; empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.batches import small_batches
from tracemill.session import stored

CHUNK = 4096  # candidates at a time
EDGES = (0.375, 0.5, 0.625, 0.75, 0.875, 1.0)  # shares of the dimensions at which candidates are compacted
EXACT = {np.float32: float(1 << 23), np.float64: float(1 << 52)}  # sums that are held exactly


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    at = 0
    for chunk in column.chunks:
        flat = chunk.flatten().to_numpy(zero_copy_only=False)
        sizes = chunk.value_lengths().to_numpy(zero_copy_only=False)
        if len(sizes) and (sizes == width).all():
            out[at : at + len(sizes)] = flat.reshape(-1, width)
        else:
            ends = np.cumsum(sizes)
            for i, (n, e) in enumerate(zip(sizes, ends, strict=True)):
                out[at + i, :n] = flat[e - n : e]
        at += len(sizes)
    return out


def _merged(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        reach = scores >= cut
        ids, scores = ids[reach], scores[reach]
    pick = np.lexsort((ids, -scores))[:k]
    return ids[pick], scores[pick]


def search(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, tally: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and integer scores of its k best rows, ties to the smaller id. own: the queries' ids. tally: gets the number of products that were computed."""
    width = max(1, rows.shape[1])
    top = [np.linalg.norm(x.astype(np.float64), axis=1).max(initial=0) for x in (queries, rows)]
    most = max(top[0] * top[1], top[1] ** 2)
    if most >= EXACT[np.float64]:  # beyond what doubles hold exactly: plain integers
        best = []
        for i in range(len(queries)):
            s = rows @ queries[i]
            ok = np.flatnonzero(ids != own[i])
            pick = ok[np.lexsort((ids[ok], -s[ok]))[:k]]
            best.append((ids[pick], s[pick]))
        return best
    kind = np.float32 if most < EXACT[np.float32] else np.float64
    mass = (rows.astype(np.float64) ** 2).sum(axis=1)
    order = np.argsort(-mass, kind="stable")
    ids, mass, q = ids[order], mass[order].astype(kind), queries.astype(kind)
    c = np.ascontiguousarray(rows[order].T.astype(kind))
    visit = np.argsort(-np.abs(q), axis=1, kind="stable")
    edges = sorted({max(1, round(width * e)) for e in EDGES})
    found = [(np.empty(0, np.int64), np.empty(0, kind)) for _ in range(len(q))]
    done = 0
    for lo in range(0, c.shape[1], CHUNK):
        part, part_ids, part_mass = c[:, lo : lo + CHUNK], ids[lo : lo + CHUNK], mass[lo : lo + CHUNK]
        square = part * part
        for i in range(len(q)):
            left = np.sqrt(np.concatenate([np.cumsum((q[i, visit[i]].astype(np.float64) ** 2)[::-1])[::-1], [0.0]]))
            least = found[i][1][-1] if len(found[i][1]) == k else -np.inf
            if left[0] * np.sqrt(float(part_mass[0])) * (1 + 1e-5) < least:
                continue  # so are all after it
            live, total, rest, at = None, None, None, 0
            for edge in edges:
                dims = visit[i, at:edge]
                if live is None:
                    total, rest = q[i, dims] @ part[dims], part_mass - square[dims].sum(axis=0)
                    live = np.flatnonzero(part_ids != own[i])
                    total, rest = total[live], rest[live]
                    done += len(dims) * len(part_ids)
                    if len(found[i][1]) < k and len(live) > k and edge < width:
                        lead = np.argpartition(-total, k)[:k]
                        later = visit[i, edge:]
                        least = (total[lead] + q[i, later] @ part[np.ix_(later, live[lead])]).min()
                        done += k * len(later)
                else:
                    spot = np.ix_(dims, live)
                    total, rest = total + q[i, dims] @ part[spot], rest - square[spot].sum(axis=0)
                    done += len(dims) * len(live)
                at = edge
                bound = left[edge] * np.sqrt(np.maximum(rest, 0))
                keep = total + bound + 1e-5 * (np.abs(total) + bound) >= least
                if not keep.all():
                    live, total, rest = live[keep], total[keep], rest[keep]
            found[i] = _merged(np.concatenate([found[i][0], part_ids[live]]), np.concatenate([found[i][1], total]), k)
    if tally is not None:
        tally.append(done)
    return [(a, np.rint(s).astype(np.int64)) for a, s in found]


def top_k(vectors: DataFrame, k: int = 20, query_step: int = 20, scale: float = 64.0, query_group: int = 4096, row_group: int = 16384) -> DataFrame:
    """vectors(vec_id, embedding) -> (query_id, rank, vec_id, score); queries are the rows whose vec_id is divisible by query_step."""
    spark = vectors.sparkSession
    small_batches(spark)
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = rows.where(F.pmod("vec_id", F.lit(query_step)) == 0).select("vec_id", "v", F.xxhash64("v").alias("vh")).dropDuplicates(["vec_id", "vh"])
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width, n_asked = facts["n"], facts["width"] or 0, asked.count()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_groups = max(1, -(-n // row_group), min(parallel, -(-n // 2048)))
    query_groups = max(1, -(-n_asked // query_group))

    deal = lambda col, groups: F.pmod(F.xxhash64(col), F.lit(groups)).cast("int")
    each = lambda groups: F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    left = asked.select("vec_id", "vh", "v", deal("vec_id", query_groups).alias("qg"), each(row_groups).alias("rg"))
    right = rows.select("vec_id", "v", deal("row", row_groups).alias("rg"), each(query_groups).alias("qg"))

    last = np.iinfo(np.int64).max

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        own = a.column("vec_id").to_numpy()
        raw = b.column("vec_id").combine_chunks().fill_null(last).to_numpy()
        best = search(_matrix(a.column("v"), width), own, _matrix(b.column("v"), width), raw, k)
        sizes = [len(x) for x, _ in best]
        cat = lambda xs: np.concatenate(xs) if xs else np.empty(0, np.int64)
        ids = cat([x for x, _ in best])
        return pa.table({"query_id": np.repeat(own, sizes), "vh": np.repeat(a.column("vh").to_numpy(), sizes), "vec_id": pa.array(ids, pa.int64(), mask=ids == last), "score": cat([s for _, s in best])})

    made = left.groupBy("qg", "rg").cogroup(right.groupBy("qg", "rg")).applyInArrow(cell, "query_id long, vh long, vec_id long, score long")
    ranked = made.withColumn("rank", F.expr("row_number() over (partition by query_id, vh order by score desc, vec_id asc nulls last)")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
