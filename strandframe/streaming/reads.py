"""Streams of reads matched against stored sequences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.iupac import normalise
from strandframe.operators.search import concrete, kmers, locate


def locate_stream(reads: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """(query_id, seq_id, pos) of a stream (query_id, pattern) of ACGT patterns, as locate finds them in a batch.

    A stateless join of the stream's seeds with the k-mers of refs, so it runs in append mode; patterns shorter than k
    are joined with k-mers of their own length.
    """
    reads = reads.select("query_id", normalise(F.col("pattern")).alias("pattern")).filter(concrete(F.col("pattern")) | (F.col("pattern") == ""))
    found = [reads.filter("pattern = ''").select("query_id", F.lit(1).alias("_one")).join(locate(refs, "").select("seq_id", "pos", F.lit(1).alias("_one")), "_one").drop("_one")]
    for n in range(1, k + 1):
        own = reads.filter(F.length("pattern") == n if n < k else F.length("pattern") >= k).withColumn("kmer", F.substring("pattern", 1, n))
        hits = own.join(kmers(refs, ["seq_id"], "seq", n, "pos"), "kmer")
        if n == k:
            whole = F.substring(F.col("seq"), F.col("pos") + 1, F.length("pattern")) == F.col("pattern")
            hits = hits.join(refs.select("seq_id", "seq"), "seq_id").filter(whole)
        found.append(hits.select("query_id", "seq_id", "pos"))
    return reduce(DataFrame.unionByName, found)
