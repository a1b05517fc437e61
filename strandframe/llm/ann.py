"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted on a bounded sample by balanced splits.  Every vector is written to the list of
its nearest centroid and, near a border, to further ones.  A query walks a neighbour graph of the
centroids held in memory, takes every list whose distance ratio to the nearest is small, however many, and
the vectors of those lists are compared exactly, in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush, heappushpop

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

SAMPLE, LIST_SIZE, MAX_LISTS = 20_000, 96, 2048  # some 10 rows of the sample for each centroid at least
REPLICAS, BORDER = 4, 1.12  # a vector joins up to REPLICAS lists within BORDER of its nearest distance
PROBE_RATIO, LEAST_LISTS = 1.2, 24  # all lists up to PROBE_RATIO times the nearest centroid's distance
TASK_ROWS = 4096  # longer lists are compared in parts of about so many rows


def usable(embedding: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def balanced_centroids(x: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """k centroids, by splitting the largest cell in equal halves along the line between two means."""
    rng = np.random.default_rng(seed)
    cells = [(-len(x), 0, np.arange(len(x)))]
    made = 1
    while len(cells) < k:
        size, _, rows = heappop(cells)
        if -size < 2:
            heappush(cells, (size, made, rows))
            break
        part = x[rows]
        a, b = part[rng.choice(len(rows), 2, replace=False)]
        for _ in range(4):
            side = part @ (a - b)
            near = side >= np.median(side)
            if near.all() or not near.any():
                near = np.arange(len(rows)) < len(rows) // 2
            a, b = part[near].mean(0), part[~near].mean(0)
        for rows_of in (rows[near], rows[~near]):
            heappush(cells, (-len(rows_of), made, rows_of))
            made += 1
    return np.stack([x[rows].mean(0) for _, _, rows in cells]).astype("f4")


class CentroidGraph:
    """Nearest-neighbour graph of the centroids, searched best first."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, entries: int = 8):
        self.points = centroids
        n = len(centroids)
        near = [np.argsort(((centroids - c) ** 2).sum(1), kind="stable")[1 : degree + 1] for c in centroids]
        both: list[set[int]] = [set(map(int, x)) for x in near]
        for i, x in enumerate(near):
            for j in x:
                both[int(j)].add(i)
        self.near = [np.array(sorted(x), dtype="i8") for x in both]
        self.entries = np.unique(np.linspace(0, n - 1, min(entries, n)).astype("i8"))

    def search(self, q: np.ndarray, want: int, ratio: float = PROBE_RATIO) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances), nearest first: all up to `ratio` times the nearest distance that a walk meets, `want` at least.

        The walk goes on to 1.05 times that distance and to the 2 * want nearest, so that it passes gaps.
        """
        beam = 2 * want
        seen = np.zeros(len(self.points), bool)
        heap: list[tuple[float, int]] = []
        found: list[tuple[float, int]] = []
        nearest: list[float] = []  # the beam smallest distances met, negated, largest on top
        least = np.inf
        fresh = self.entries
        while True:
            seen[fresh] = True
            d = np.sqrt(((self.points[fresh] - q) ** 2).sum(1))
            for item in zip(d.tolist(), fresh.tolist()):
                found.append(item)
                heappush(heap, item)
                (heappush if len(nearest) < beam else heappushpop)(nearest, -item[0])
                least = min(least, item[0])
            fresh = self.entries[:0]
            while heap and not len(fresh):
                dist, node = heappop(heap)
                if len(nearest) >= beam and dist > max(-nearest[0], 1.05 * ratio * least):
                    heap.clear()
                    break
                near = self.near[node]
                fresh = near[~seen[near]]
            if not len(fresh):
                break
        found.sort()
        reach = sum(x <= least * ratio + 1e-9 for x, _ in found)
        found = found[: max(want, reach)]
        return np.array([i for _, i in found]), np.array([x for x, _ in found])


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates all other rows.  Vectors that are null,
    zero, hold null or non-finite components, have no id or another length than most take no part.  Of equal
    vectors the k + 1 smallest ids are kept, as no more can be among k nearest.  An empty table gives none.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("v")).filter(usable(F.col("v")) & F.col("vec_id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("v") == lengths[0]["n"])
    copies = Window.partitionBy("v").orderBy("vec_id")
    distinct = cut(rows.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1))

    total = distinct.count()
    rate = min(1.0, 1.2 * SAMPLE / total)
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1
    sample = distinct.filter((F.col("copy") == 1) & draw).select("vec_id", "v").limit(2 * SAMPLE).toPandas().sort_values("vec_id")
    if sample.empty:
        sample = distinct.select("vec_id", "v").limit(SAMPLE).toPandas()
    known, known_ids = np.stack(sample["v"]).astype("f8"), sample["vec_id"].to_numpy()
    known_norms = (known**2).sum(1)
    x = known.astype("f4")
    centroids = balanced_centroids(x, max(1, min(MAX_LISTS, -(-total // LIST_SIZE), len(x))))
    norms = (centroids**2).sum(1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                v = np.stack(part["v"]).astype("f4")
                d = np.maximum((v**2).sum(1)[:, None] + norms[None] - 2 * v @ centroids.T, 0)
                top = np.argsort(d, axis=1, kind="stable")[:, :REPLICAS]
                near = np.take_along_axis(d, top, 1)
                row, col = np.nonzero(near <= np.maximum(near[:, :1], 1e-12) * BORDER**2)
                yield pd.DataFrame({"list": top[row, col].astype("i8"), "vec_id": part["vec_id"].to_numpy()[row], "v": part["v"].to_numpy()[row]})

    kind = dict(distinct.dtypes)["v"]
    postings = cut(distinct.select("vec_id", "v").mapInPandas(place, f"list long, vec_id long, v {kind}"))
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # at most MAX_LISTS rows

    def bounds(ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A distance that the k-th neighbour of each query is not beyond: that of the k-th in the sample."""
        if len(known) <= k:
            return np.full(len(q), np.inf)
        sizes_of = (q**2).sum(1)[:, None]
        d = sizes_of + known_norms - 2 * q @ known.T
        d[ids[:, None] == known_ids] = np.inf
        far = np.partition(d, k - 1, axis=1)[:, k - 1]
        far = np.sqrt(np.maximum(far, 0) + 1e-9 * (sizes_of[:, 0] + known_norms.max()))
        return np.where(np.isfinite(far), far, np.inf)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = CentroidGraph(centroids)
        for batch in batches:
            for start in range(0, len(batch), 64):
                some = batch.iloc[start : start + 64]
                far = bounds(some["query_id"].to_numpy(), np.stack(some["q"]).astype("f8"))
                for q, v, bound in zip(some["query_id"], some["q"], far):
                    want, n = min(LEAST_LISTS, len(centroids)), len(centroids)
                    while True:
                        lists, _ = graph.search(np.asarray(v, "f4"), want)
                        if sum(sizes.get(int(i), 0) for i in lists) > (k + 1) * REPLICAS or want >= n:
                            break
                        want = min(n, want * 2)
                    at = [(int(i), part) for i in lists for part in range(-(-sizes.get(int(i), 0) // TASK_ROWS))]
                    yield pd.DataFrame({"query_id": q, "q": [v] * len(at), "bound": bound, "list": [i for i, _ in at], "part": [j for _, j in at]})

    def compare(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """The k nearest of one part of a list for each query that takes the list; none beyond the query's bound.

        Squared distances by matrix product choose the rows, with room for rounding; their distances are then taken directly.
        """
        out: list[tuple] = []
        if len(asked) and len(held):
            v, ids = np.stack(held["v"]).astype("f8"), held["vec_id"].to_numpy()
            norms_of = (v**2).sum(1)
            for start in range(0, len(asked), 256):
                some = asked.iloc[start : start + 256]
                points = np.stack(some["q"]).astype("f8")
                room = 1e-9 * (norms_of.max() + (points**2).sum(1))
                rough = norms_of + (points**2).sum(1)[:, None] - 2 * points @ v.T
                for q, point, bound, guess, r in zip(some["query_id"], points, some["bound"], rough, room):
                    rows_of = np.arange(len(v))
                    if np.isfinite(guess).all():
                        last = np.partition(guess, k)[k] if len(v) > k + 1 else np.inf
                        rows_of = np.flatnonzero(guess <= min(last, bound**2) + 2 * r)
                    d = np.sqrt(((v[rows_of] - point) ** 2).sum(1))
                    best = np.lexsort((ids[rows_of], d))[: k + 1]
                    best = best[ids[rows_of[best]] != q][:k]
                    if len(best):
                        out.append((q, ids[rows_of[best]], d[best]))
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    probes = queries.mapInPandas(probe, f"query_id long, q {kind}, bound double, list long, part long")
    hot = [(i, -(-n // TASK_ROWS)) for i, n in sizes.items() if n > TASK_ROWS]
    parts = spark.createDataFrame(hot, "list long, parts long")
    placed = postings.join(F.broadcast(parts), "list", "left").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1)))).drop("parts")
    found = probes.groupBy("list", "part").cogroup(placed.groupBy("list", "part")).applyInPandas(compare, "query_id long, vec_id array<long>, score array<double>")
    scored = (
        found.select("query_id", F.inline(F.arrays_zip("vec_id", "score")))
        .groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
