"""Maximal exact matches between reads and sequences.

Every match of at least min_len symbols is a run of consecutive matching seeds on one diagonal, so seeds of at
most min_len symbols are equi-joined and runs are found as gaps and islands; of the starts of the runs that are long
enough, those are maximal whose end passes all earlier ends of the read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions.iupac import Alphabet, normalise

from .search import WIDEST, askers, few, kmers, scanned, seed_hits

SEED = 32  # the longest seeds without ambiguity codes


def _reads(reads: DataFrame) -> DataFrame:
    return reads.select("query_id", normalise(F.col("pattern")).alias("pattern"))


def runs(refs: DataFrame, reads: DataFrame, min_len: int, alphabet: Alphabet = "exact", small: bool = False) -> DataFrame:
    """(query_id, seq_id, diag, begin, end): runs of at least min_len matching symbols that can't be longer, in read places."""
    k = min(min_len, SEED if alphabet == "exact" else WIDEST)
    hits = seed_hits(kmers(reads, ["query_id"], "pattern", k, "i"), refs, k, alphabet, small).withColumn("diag", F.col("p") - F.col("i"))
    diag = Window.partitionBy("query_id", "seq_id", "diag").orderBy("i")
    island = hits.withColumn("island", F.col("i") - F.row_number().over(diag))
    found = island.groupBy("query_id", "seq_id", "diag", "island").agg(F.min("i").alias("begin"), (F.max("i") + k).alias("end")).drop("island")
    return found.filter(F.col("end") - F.col("begin") >= min_len)


def find_mems(refs: DataFrame, reads: DataFrame, min_len: int, alphabet: Alphabet = "exact") -> DataFrame:
    """(query_id, query_start, query_end, match_count) of all maximal matches; none if min_len is under 1.

    Reads are taken in upper case with U as T; a null or empty one matches nowhere.
    """
    if min_len < 1:
        return _nothing(reads)
    span, reads = ["query_id", "query_start", "query_end"], _reads(reads)
    if alphabet == "iupac" and (texts := scanned(reads, max(1, min_len // 3))) is not None:
        # Places are counted once for each different text, whoever asks for it.
        spans, places = _scanned(refs, texts, min_len)
        counted = places.groupBy("span").agg(F.count("*").alias("n")).join(F.broadcast(spans), "span")
        return counted.join(askers(reads, texts), "which").groupBy(*span).agg(F.sum("n").alias("match_count"))
    return _joined(refs, reads, min_len, alphabet).groupBy(*span).agg(F.count("*").alias("match_count"))


def _held(refs: DataFrame, reads: DataFrame, min_len: int, alphabet: Alphabet) -> DataFrame:
    """(query_id, query_start, query_end, seq_id, diag): each run with each maximal span that it holds."""
    reads = _reads(reads)
    if alphabet == "iupac" and (texts := scanned(reads, max(1, min_len // 3))) is not None:
        spans, places = _scanned(refs, texts, min_len)
        names = spans.join(askers(reads, texts), "which")
        asked = places.join(F.broadcast(names) if few(reads) else names, "span")
        return asked.select("query_id", "query_start", "query_end", "seq_id", (F.col("pos") - F.col("query_start")).alias("diag"))
    return _joined(refs, reads, min_len, alphabet)


def _joined(refs: DataFrame, reads: DataFrame, min_len: int, alphabet: Alphabet) -> DataFrame:
    """_held by joined seeds.

    A read has at most as many spans as symbols; they come along as one array, so a run is joined with one row.
    """
    small = few(reads)
    found = runs(refs, reads, min_len, alphabet, small)
    spans = _maximal(found).groupBy("query_id").agg(F.collect_list(F.struct("query_start", "query_end")).alias("spans"))
    inside = F.filter("spans", lambda s: (F.col("begin") <= s["query_start"]) & (F.col("end") >= s["query_end"]))
    return found.join(F.broadcast(spans) if small else spans, "query_id").select("query_id", F.inline(inside), "seq_id", "diag")


def _scanned(refs: DataFrame, texts: list[str], min_len: int) -> tuple[DataFrame, DataFrame]:
    """(which, span, query_start, query_end), (span, seq_id, pos): the maximal spans of different texts by one search of all places, and where these stand by another.

    A run holds a span exactly if the span stands there, so runs that hold none are never listed. Equal spans have one number.
    """
    from . import scan
    from .index import cut

    numbers, spans = {}, []
    pieced, size = scan.laid(refs, texts)
    pieced = cut(pieced)  # read twice
    for which, ends in enumerate(scan.longest(pieced, texts, min_len)):
        reach = 0
        for begin, end in sorted(ends):
            if end > reach:
                spans.append((which, numbers.setdefault(texts[which][begin:end], len(numbers)), begin, end))
                reach = end
    listed = refs.sparkSession.createDataFrame(spans, "which int, span int, query_start int, query_end int")
    if not spans:
        return listed, refs.select(F.lit(0).alias("span"), "seq_id", F.lit(0).alias("pos")).filter("false")
    return listed, scan.locate(pieced, list(numbers), size).withColumnRenamed("which", "span")


def _nothing(reads: DataFrame) -> DataFrame:
    return reads.select("query_id", F.lit(0).alias("query_start"), F.lit(0).alias("query_end"), F.lit(0).cast("long").alias("match_count")).filter("false")


def _maximal(found: DataFrame) -> DataFrame:
    earlier = Window.partitionBy("query_id").orderBy("query_start").rowsBetween(Window.unboundedPreceding, -1)
    ends = found.groupBy("query_id", F.col("begin").alias("query_start")).agg(F.max("end").alias("query_end"))
    before = F.max("query_end").over(earlier)
    return ends.withColumn("before", before).filter("before is null or before < query_end").drop("before")


def find_smems(refs: DataFrame, reads: DataFrame, min_len: int, alphabet: Alphabet = "exact") -> DataFrame:
    """Maximal matches that no other contains; the containment test is kept as a step of its own."""
    if min_len < 1:
        return _nothing(reads)
    spans = find_mems(refs, reads, min_len, alphabet)
    longest = Window.partitionBy("query_id").orderBy("query_start", F.desc("query_end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("reach", F.max("query_end").over(longest)).filter("reach is null or reach < query_end").drop("reach")


def coverage(spans: DataFrame) -> DataFrame:
    """(n): the places of all spans together, as match_count counts them."""
    return spans.agg(F.coalesce(F.sum("match_count"), F.lit(0)).cast("long").alias("n"))


def located(refs: DataFrame, reads: DataFrame, min_len: int, alphabet: Alphabet = "exact", max_hits: int | None = None) -> DataFrame:
    """(query_id, query_start, query_end, match_count, truncated, seq_id, pos): one row for each place.

    With max_hits the first so many places of a span, by seq_id and pos, stay and truncated says if more were there.
    """
    span = ["query_id", "query_start", "query_end"]
    if min_len < 1:
        return _nothing(reads).select(*span, "match_count", F.lit(False).alias("truncated"), F.lit(0).cast("long").alias("seq_id"), F.lit(0).alias("pos"))
    hits = _held(refs, reads, min_len, alphabet).select(*span, "seq_id", (F.col("query_start") + F.col("diag")).cast("int").alias("pos"))
    total = hits.groupBy(*span).agg(F.count("*").alias("match_count"))
    if max_hits is not None:
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*span).orderBy("seq_id", "pos"))).filter(F.col("rank") <= max_hits).drop("rank")
    cut = F.lit(False) if max_hits is None else F.col("match_count") > max_hits
    return hits.join(total, span).select(*span, "match_count", cut.alias("truncated"), "seq_id", "pos")
