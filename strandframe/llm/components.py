"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FEW = 1 << 20  # edges that one task joins


def _star(neighbours: DataFrame, keep: Column) -> DataFrame:
    """Point the kept neighbours of every node at the smallest member of its star."""
    centre = neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        neighbours.join(centre, "u")
        .filter(keep)
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (u, v) of one task, by union-find with the smaller root on top."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.setdefault(x, x)) != x:
            above[x] = above[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            above[max(a, b)] = min(a, b)
    nodes = sorted(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["node", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v), longs; root is the smallest node reachable.

    Up to `few` edges, which a task holds in some 200 MB, are united by one task; each round of the other way costs the
    driver the plans of seven shuffles.  More edges are first dealt out to tasks by that number and replaced by the trees that each
    makes of its own; only what stays more than `few` goes through rounds of stars.  Stars are formed with a partially aggregated minimum and an equi-join on the node; a hub's rows of that
    join are split over tasks by adaptive execution alone.  Each round is cut in the checkpoint folder.  Self-loops and repeated edges are
    harmless; no edges give no rows.
    """
    edges = cut(edges.select("u", "v").filter("u <> v").distinct())
    n = edges.count()
    while n > few > 0:
        # What one task unites is as well told by a tree, of which there are fewer edges where components are dense.
        dealt = edges.repartition(-(-n // few), "u").mapInArrow(_united, "node long, root long")
        trees = cut(dealt.select(F.col("node").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct())
        before, n = n, trees.count()
        edges = trees
        if n > before * 3 // 4:
            break
    if n <= few:
        return cut(edges.coalesce(1).mapInArrow(_united, "node long, root long"))
    state = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u"))
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        hang = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            down.join(hang, "u")
            .select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        edges = cut(small)
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (now := tuple(found)) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
