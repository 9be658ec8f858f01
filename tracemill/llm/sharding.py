"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual` points of a 64-bit ring; a row's key hash falls into
an arc, whose shard is the first that it is offered to. A shard's load is
bounded by its share of the rows (shares differ by one at most), and what
overflows a full shard continues clockwise to the next points until one has
room. Rows of one arc keep the order of a hash of their content.

Law: `rows`. The bounds add up to the number of rows, so every shard is filled
to its bound and counts are at most one apart. (Bounded loads and the pure
`key` law exclude one another: where a row goes depends on how full shards
are.) Equal texts are not kept together; that would break the bound if one text
holds a third of the rows.

How it scales: an arc is cut into cells, ranges of the content hash of some
`target` rows each; a content that alone fills a cell is a cell by itself, and
is divided by partition number, since rows that are equal in everything can
change places without changing the result. So the result depends neither on
the partitioning nor on `target`. The counts of the cells (rows / target, and
one for each arc) come to the driver, which walks the ring over counts, not
rows, and returns for every cell which runs of ranks go to which shard and
slot. Ranking within a cell is one window over narrow rows; texts are not
shuffled.

Given cases: null ids hash like the text 'null'; null text has size 1 and
checksum 0; repeated rows are rows like any other, and so are ties; a very long
text counts by its size and checksum only; an empty table gives an empty one;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import stored


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order, positions as signed longs."""
    points = []
    for s in range(shards):
        for v in range(virtual):
            h = int.from_bytes(hashlib.blake2b(f"shard-{s}-node-{v}".encode(), digest_size=8).digest(), "big")
            points.append((h - (1 << 63), s))
    return sorted(points)


def walk(counts: dict[int, int], owners: list[int], bounds: list[int]) -> dict[int, list[tuple[int, int]]]:
    """counts: rows by arc -> by arc the shards its rows go to in order, with how many each takes.

    Arcs are first served by their own shard, in ring order; what is left
    over then moves clockwise, all arcs by one point at a time.
    """
    room = list(bounds)
    out: dict[int, list[tuple[int, int]]] = defaultdict(list)
    left = dict(counts)
    for hop in range(len(owners) + 1):
        for arc in sorted(left):
            shard = owners[(arc + hop) % len(owners)]
            n = min(left[arc], room[shard])
            if n:
                out[arc].append((shard, n))
                room[shard] -= n
                left[arc] -= n
        left = {a: n for a, n in left.items() if n}
        if not left:
            return out
    raise AssertionError("bounds are smaller than the rows")


def points_before(at: Column, positions: list[int], equal: bool = False) -> Column:
    """How many of the sorted points are below `at` (or equal to it, if asked for), by binary search. On a ring that is the row's arc: it ends at the next point, and past the last the ring starts again."""
    if not positions:
        return F.lit(0)
    points = F.array(*[F.lit(p).cast("long") for p in positions])
    middle = lambda a: F.shiftright(a["lo"] + a["hi"], 1)
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        point = F.element_at(points, F.least(middle(a) + 1, F.lit(len(positions))))
        below = point <= at if equal else point < at
        return F.when(a["lo"] >= a["hi"], a).when(below, pair(middle(a) + 1, a["hi"])).otherwise(pair(a["lo"], middle(a)))

    turns = F.array(*[F.lit(0)] * len(positions).bit_length())
    return F.aggregate(turns, pair(F.lit(0), F.lit(len(positions))), halve, lambda a: a["lo"])


def assign(docs: DataFrame, shards: int = 8, virtual: int = 64, target: int = 100_000) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    spark = docs.sparkSession
    points = ring(shards, virtual)
    owners = [s for _, s in points]
    positions = [p for p, _ in points]
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text).cast("long") + 1, F.lit(1).cast("long")).alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0).cast("long")).alias("text_crc32"),
    )
    at = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = rows.withColumn("arc", F.pmod(points_before(at, positions), F.lit(len(positions))))
    rows = stored(rows.withColumn("h", F.xxhash64("doc_id", "size", "text_crc32")).withColumn("part", F.spark_partition_id()), "shard-rows")
    total = rows.count()
    cells = max(1, -(-total // (target * len(points))))
    cell = F.least(F.lit(cells - 1), F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * cells)).cast("int")
    rows = rows.withColumn("cell", cell)

    # contents that fill a cell: at most total / target of them
    large = rows.groupBy("arc", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 2 * target)
    hot = rows.join(F.broadcast(large.select("arc", "cell")), ["arc", "cell"]).groupBy("arc", "cell", "h").agg(F.count("*").alias("n")).where(F.col("n") > target)
    hot = spark.createDataFrame([tuple(r) for r in hot.collect()], "arc int, cell int, h long, n long")
    hot = hot.groupBy("arc", "cell").agg(F.sort_array(F.collect_list("h")).alias("hots"), F.max("n").alias("n"))
    rows = rows.join(F.broadcast(hot), ["arc", "cell"], "left")
    is_hot = F.coalesce(F.array_contains("hots", F.col("h")), F.lit(False))
    sub = F.coalesce(2 * F.size(F.filter("hots", lambda x: x < F.col("h"))), F.lit(0)) + is_hot.cast("int")
    salt = F.when(is_hot, F.pmod(F.col("part"), F.ceil(F.col("n") / target).cast("int"))).otherwise(0)
    rows = rows.withColumn("sub", F.when(F.col("hots").isNull(), 0).otherwise(sub)).withColumn("salt", salt).drop("hots", "n", "part")

    where = ["arc", "cell", "sub", "salt"]
    found = {(r["arc"], r["cell"], r["sub"], r["salt"]): r["n"] for r in rows.groupBy(*where).agg(F.count("*").alias("n")).collect()}
    bounds = [total // shards + (s < total % shards) for s in range(shards)]
    by_arc: dict[int, int] = defaultdict(int)
    for (arc, *_), n in found.items():
        by_arc[arc] += n
    goes = walk(by_arc, owners, bounds)

    # runs: ranks [lo, hi) of a cell -> shard, and what to add to the rank for the slot
    taken, runs, queues = [0] * shards, [], {arc: [list(x) for x in goes[arc]] for arc in by_arc}
    for (arc, *rest), n in sorted(found.items()):
        queue, lo = queues[arc], 0
        while lo < n:
            shard, room = queue[0]
            step = min(room, n - lo)
            runs.append((arc, *rest, lo, lo + step, shard, taken[shard] - lo))
            taken[shard] += step
            lo += step
            queue[0][1] -= step
            if not queue[0][1]:
                queue.pop(0)
    table = spark.createDataFrame(runs, "arc int, cell int, sub int, salt int, lo long, hi long, shard int, shift long")
    ranked = rows.withColumn("rank", F.expr(f"row_number() over (partition by {', '.join(where)} order by h, doc_id, size, text_crc32) - 1"))
    out = ranked.join(F.broadcast(table), where).where("rank >= lo and rank < hi")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") + F.col("shift")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
