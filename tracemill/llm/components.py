"""Connected components of a link table, fully distributed.

Each round, every node points at the member of its closed neighbourhood with
the smallest hash (fresh per round); the links are then rewritten onto those
members. A homomorphic image of a connected graph is connected, so components
are kept, and the random order shrinks chains by a constant factor per round
(smallest-id pointers would shorten an ordered chain by one). Each round is
written to the shared folder, which cuts the lineage; only a row count comes
to the driver. A node with a very large neighbourhood is reduced by map-side
partial minima, and the relabelling joins are plain equi-joins that adaptive
execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.session import Scratch, discard, stored


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a long, b long) -> (node, comp), a stored table, comp being the smallest node of the component. Loops and repeats are fine; an empty table gives an empty one."""
    edges = stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    roots = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("root")), "roots")
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("h"), c.alias("v"))
        step = stored(both.groupBy("node").agg(F.min(rank(F.col("other"))).alias("m")).select("node", F.least("m", rank(F.col("node")))["v"].alias("to")), "step")
        moved = edges.join(step.toDF("a", "a2"), "a").join(step.toDF("b", "b2"), "b")
        moved = moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        fresh_edges = stored(moved, "edges")
        fresh_roots = stored(roots.join(step.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        for old in (edges, roots, step):
            discard(old)
        edges, roots = fresh_edges, fresh_roots
    else:
        raise RuntimeError("components did not settle")
    discard(edges)
    least = roots.groupBy("root").agg(F.min("node").alias("comp"))
    out = stored(roots.join(least, "root").select("node", "comp"), "components")
    discard(roots)
    return out


def joined(comps: DataFrame, links: DataFrame, keep: Scratch) -> DataFrame:
    """comps(node, comp) as components() gave them, and further links(a, b) -> (node, comp) of both together, as long as `keep` lives. Only the links between different components are worked on."""
    of = lambda side: comps.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))
    both = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = stored(both.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct(), "edges")
    if between.isEmpty():
        discard(between)
        return comps
    found = components(between)
    keep.held.append(found)
    discard(between)
    upper = found.toDF("own", "top")
    moved = comps.join(upper, F.col("comp") == F.col("own"), "left").select("node", F.coalesce("top", "comp").alias("comp"))
    single = upper.join(comps.select(F.col("node").alias("own")), "own", "left_anti").select("own", "top")
    return moved.union(single)
