"""Length buckets that minimise padding, and token-budget batches inside each bucket.

The histogram of lengths is gathered once over all rows, in bins of one length up to `exact` and of
under 1/exact of the length beyond, so it stays small whatever the corpus; dynamic programming over
its cells finds the `n_buckets` upper bounds with the least total padding.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.index import prefix_sum

from .common import cut

SCHEMA = "doc_id long, n_tokens long, bucket int, bucket_len long, batch_id long, slot int, padding long"


def n_words(text: Column) -> Column:
    """White-space words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def best_bounds(count: np.ndarray, total: np.ndarray, top: np.ndarray, n_buckets: int) -> list[int]:
    """Upper bounds of at most n_buckets runs of the cells (ascending) with the least padding.

    count, total, top: rows, summed length and largest length of each cell.  Padding of a run is
    rows * its top - summed length.  Ties go to the shorter last run.
    """
    n = len(count)
    rows, tokens = np.concatenate(([0], np.cumsum(count))), np.concatenate(([0], np.cumsum(total)))
    best = np.full(n + 1, np.inf)
    best[0] = 0
    back = []
    for _ in range(min(n_buckets, n)):
        now, frm = np.full(n + 1, np.inf), np.zeros(n + 1, "i8")
        now[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + (rows[j] - rows[:j]) * float(top[j - 1]) - (tokens[j] - tokens[:j])
            frm[j] = j - 1 - int(np.argmin(cost[::-1]))
            now[j] = cost[frm[j]]
        back.append(frm)
        best = now
    bounds, j = [], n
    for frm in reversed(back):
        if j == 0:
            break
        bounds.append(int(top[j - 1]))
        j = int(frm[j])
    return bounds[::-1]


def _bin(n: Column, exact: int) -> Column:
    """Cell of a length: itself up to `exact`, then rounded up to a multiple of a power of two."""
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double") / exact)))).cast("long")
    return F.when(n <= exact, n).otherwise(F.ceil(n / step).cast("long") * step)


def pack(docs: DataFrame, budget: int = 16384, n_buckets: int = 32, length: Column | None = None, exact: int = 1024) -> DataFrame:
    """Bucket, batch and slot of every row of docs (columns doc_id and text; others are ignored).

    length: tokens of a row, white-space words of text by default; null counts as 0.  A batch holds
    budget // bucket_len rows, at least one, so only a row longer than the budget exceeds it.  Within a
    bucket rows are in ascending order of doc_id (null first) and all batches but the last are full.
    Rows are numbered over range partitions and their totals, so a bucket of any size is dealt over tasks.
    Repeated rows and null ids are packed like any other; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    tokens = F.coalesce((n_words(F.col("text")) if length is None else length).cast("long"), F.lit(0).cast("long"))
    sized = cut(docs.select(F.col("doc_id").cast("long"), tokens.alias("n_tokens"), F.monotonically_increasing_id().alias("_row")))
    cells = (
        sized.groupBy(_bin(F.col("n_tokens"), exact).alias("cell"))
        .agg(F.count("*").alias("n"), F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("top"))
        .toPandas().sort_values("cell")
    )
    if cells.empty:
        return spark.createDataFrame([], SCHEMA)
    bounds = best_bounds(cells["n"].to_numpy(), cells["total"].to_numpy(), cells["top"].to_numpy(), n_buckets)
    in_bucket = np.add.reduceat(cells["n"].to_numpy(), np.searchsorted(cells["top"].to_numpy(), [-1, *bounds[:-1]], "right"))
    starts = np.cumsum(in_bucket) - in_bucket

    bucket = F.lit(0)
    for bound in bounds[:-1]:
        bucket = bucket + (F.col("n_tokens") > bound).cast("int")
    at = F.col("bucket") + 1
    of_bucket = lambda values: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in values]), at)
    placed = sized.withColumn("bucket", bucket).withColumn("one", F.lit(1))
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1))))
    return (
        prefix_sum(placed, ["bucket", "doc_id", "_row"], "one", "before")
        .withColumn("bucket_len", of_bucket(bounds)).withColumn("index", F.col("before") - of_bucket(starts))
        .select(
            "doc_id", "n_tokens", "bucket", "bucket_len",
            F.floor(F.col("index") / per_batch).cast("long").alias("batch_id"),
            F.pmod(F.col("index"), per_batch).cast("int").alias("slot"),
            (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
        )
    )


def sql(budget: int = 16384, n_buckets: int = 32, exact: int = 1024) -> str:
    """What pack gives for the table documents, in DuckDB's SQL: the rounds of the dynamic programme, one after another."""
    cell = f"CASE WHEN n <= {exact} THEN n ELSE (ceil(n / step) * step)::BIGINT END"
    rounds = ", ".join(
        f"""f{k} AS MATERIALIZED (SELECT j, found[1] AS best, -found[2] AS back FROM (SELECT y.j, min([x.best + (y.r - x.r) * y.top - (y.t - x.t), -x.j]) AS found FROM p y JOIN (SELECT * FROM f{k - 1} JOIN p USING (j)) x ON x.j < y.j GROUP BY y.j)
        UNION ALL SELECT 0, 0, 0)""" for k in range(1, n_buckets + 1)
    )
    ends = ", ".join(f"z{k - 1} AS (SELECT back AS j FROM f{k} JOIN z{k} USING (j))" for k in range(n_buckets, 0, -1))
    met = " UNION ".join(f"SELECT j FROM z{k}" for k in range(1, n_buckets + 1))
    return f"""WITH d AS (SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n FROM documents),
    e AS (SELECT n, {cell} AS cell FROM (SELECT n, greatest(1, pow(2, floor(log2(greatest(n, 1) / {exact}.0))))::BIGINT AS step FROM d)),
    c AS (SELECT row_number() OVER (ORDER BY cell) AS j, count(*) AS size, sum(n) AS total, max(n) AS top FROM e GROUP BY cell),
    p AS MATERIALIZED (SELECT 0::BIGINT AS j, 0::BIGINT AS r, 0::BIGINT AS t, 0::BIGINT AS top UNION ALL SELECT j, (sum(size) OVER (ORDER BY j))::BIGINT, (sum(total) OVER (ORDER BY j))::BIGINT, top FROM c),
    f0 AS (SELECT 0::BIGINT AS j, 0::BIGINT AS best), {rounds}, z{n_buckets} AS (SELECT max(j) AS j FROM p), {ends},
    g AS (SELECT top, coalesce(lag(top) OVER (ORDER BY top), -1) AS under, (row_number() OVER (ORDER BY top) - 1)::INT AS bucket FROM p WHERE j > 0 AND j IN ({met})),
    i AS (SELECT doc_id, n, bucket, top, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST) - 1 AS place, greatest(1, {budget} // greatest(top, 1)) AS per FROM d JOIN g ON n > under AND n <= top)
    SELECT doc_id, n AS n_tokens, bucket, top AS bucket_len, (place // per)::BIGINT AS batch_id, (place % per)::INT AS slot, top - n AS padding FROM i"""
