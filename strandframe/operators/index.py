"""Full-text index structures as DataFrames: suffix array, BWT, C array, Occ, LF, samples, k-mer table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions.iupac import alphabet_table, code_of, coded, decoded
from strandframe.sources.sequences import offsets

from .search import concrete, kmers, pieces

BLOCK = 4096


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the checkpoint folder the session names; only a local session gets one of its own where none is named."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="strandframe-"))
    return df.checkpoint(eager=True)


def prefix_sum(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with out = the sum of value over all rows before in order, without a global window.

    Rows are range-partitioned; sums inside a range start from the totals of the ranges before it.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_n"))
    base = totals.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(base), "_part").withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_part", "_base")


def text(seqs: DataFrame) -> DataFrame:
    """(text_pos, code, is_start): the joined text, one row for each symbol and end mark."""
    placed = offsets(seqs).select("start", F.concat("seq", F.lit("$")).alias("seq"))
    at = pieces(placed, ["start"], F.col("seq")).select("start", "_base", F.posexplode(F.split("_piece", "")).alias("i", "sym")).filter("sym <> ''")
    place = F.col("_base") + F.col("i")
    return at.select((F.col("start") + place).alias("text_pos"), code_of(F.col("sym")).alias("code"), (place == 0).alias("is_start"))


def ordered(symbols: DataFrame) -> DataFrame:
    """The suffix array with the symbol before each suffix in records of 65,536 rows, cut; see suffixes.ordered."""
    from . import suffixes  # needs numpy and pyarrow

    return suffixes.ordered(symbols)


def suffix_array(symbols: DataFrame) -> DataFrame:
    """(row, text_pos) by prefix doubling; a round only takes the suffixes that still share a rank."""
    from . import suffixes

    return suffixes.places(suffixes.ordered(symbols))


def transform_of(table: DataFrame) -> DataFrame:
    """(row, code) of ordered(), as bwt gives it."""
    from . import suffixes

    return suffixes.transform(table)


def lf_of(table: DataFrame) -> DataFrame:
    """(row, code, lf) of ordered(), as lf_mapping gives it."""
    from . import suffixes

    return suffixes.lf(table)


def occ_checkpoints_of(table: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, code, before) of ordered(), as occ_checkpoints gives it."""
    from . import suffixes

    return suffixes.checkpoints(table, block)


def ranks_of(table: DataFrame, codes: list[int]) -> DataFrame:
    """(code, i, rank) of ordered() for all i from 1 on, as rank gives them."""
    from . import suffixes

    return suffixes.ranks(table, codes)


def sampled_of(table: DataFrame, rate: int = 32) -> DataFrame:
    """(row, text_pos) of ordered(), as sampled gives them."""
    from . import suffixes

    return suffixes.samples(table, rate)


def resolved_of(table: DataFrame, rate: int = 32) -> DataFrame:
    """(row, text_pos) of all rows of ordered(), as resolve gives them from every rate-th position."""
    from . import suffixes

    return suffixes.resolved(table, rate)


def bwt(symbols: DataFrame, sa: DataFrame) -> DataFrame:
    """(row, code): the symbol before each suffix, the last one before the first."""
    n = symbols.agg(F.max("text_pos") + 1).first()[0]
    before = symbols.select(F.pmod(F.col("text_pos") + 1, F.lit(n)).alias("text_pos"), "code")
    return sa.join(before, "text_pos").select("row", "code")


def c_array(symbols: DataFrame) -> DataFrame:
    """(code, sym, n, smaller): occurrences of each of the 16 symbols and of all smaller ones."""
    counted = alphabet_table(symbols.sparkSession).select("code", "sym").join(symbols.groupBy("code").agg(F.count("*").alias("n")), "code", "left")
    smaller = Window.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("code", "sym", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("smaller"))


def occ_checkpoints(transform: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, code, before): how often each symbol that occurs stands before each block.

    One prefix sum runs over all codes and blocks, from which each code's start is taken.
    """
    counts = transform.groupBy(F.floor(F.col("row") / block).alias("block"), "code").agg(F.count("*").alias("n"))
    grid = counts.select("block").distinct().join(F.broadcast(counts.select("code").distinct()))  # 16 codes at most
    summed = prefix_sum(grid.join(counts, ["block", "code"], "left").fillna(0, ["n"]), ["code", "block"], "n", "before")
    first = F.broadcast(counts.groupBy("code").agg(F.sum("n").alias("all")).select("code", F.coalesce(F.sum("all").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("smaller")))
    return summed.join(first, "code").select("block", "code", (F.col("before") - F.col("smaller")).alias("before"))


def rank(transform: DataFrame, checkpoints: DataFrame, asked: DataFrame, block: int = BLOCK) -> DataFrame:
    """asked (code, i) with rank = occurrences of code in rows before i, by one window over each block's symbols and questions."""
    asks = asked.select("code", F.col("i").alias("at"), F.lit(0).alias("n")).withColumn("block", F.floor(F.col("at") / block))
    symbols = transform.select("code", F.col("row").alias("at"), F.lit(1).alias("n")).withColumn("block", F.floor(F.col("at") / block))
    both = symbols.join(F.broadcast(asks.select("block").distinct()), "block", "left_semi").unionByName(asks)  # only blocks that are asked about are dealt out
    inside = Window.partitionBy("block", "code").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = both.withColumn("near", F.sum("n").over(inside)).filter("n = 0").withColumnRenamed("at", "i").drop("n")
    last = checkpoints.groupBy("code").agg(F.max("block").alias("last"))
    total = transform.groupBy("code").agg(F.count("*").alias("total"))
    return (
        at.join(checkpoints, ["block", "code"], "left").join(F.broadcast(last), "code", "left").join(F.broadcast(total), "code", "left")
        .select("code", "i", F.when(F.col("block") > F.col("last"), F.col("total")).otherwise(F.coalesce("before", F.lit(0)) + F.coalesce("near", F.lit(0))).cast("long").alias("rank")).fillna(0, ["rank"])
    )


def rank_pairs(transform: DataFrame, checkpoints: DataFrame, intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """intervals (code, lo, hi) with rank_lo and rank_hi."""
    asked = intervals.select("code", F.explode(F.array("lo", "hi")).alias("i")).distinct()
    known = rank(transform, checkpoints, asked, block)
    at = lambda name: known.select("code", F.col("i").alias(name), F.col("rank").alias(f"rank_{name}"))
    return intervals.join(at("lo"), ["code", "lo"]).join(at("hi"), ["code", "hi"]).select("code", "lo", "hi", "rank_lo", "rank_hi")


def smaller_in(transform: DataFrame, intervals: DataFrame, block: int = BLOCK) -> DataFrame:
    """intervals (code, lo, hi) with smaller = how many symbols below code stand in rows lo to hi - 1."""
    below = intervals.select("code", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("b")).filter("b < code")
    ranks = rank_pairs(transform, occ_checkpoints(transform, block), below.select(F.col("b").alias("code"), "lo", "hi").distinct(), block)
    counted = below.join(ranks.withColumnRenamed("code", "b"), ["b", "lo", "hi"]).groupBy("code", "lo", "hi").agg(F.sum(F.col("rank_hi") - F.col("rank_lo")).alias("smaller"))
    return intervals.join(counted, ["code", "lo", "hi"], "left").select("code", "lo", "hi", F.coalesce("smaller", F.lit(0)).alias("smaller"))


def lf_mapping(transform: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, code, lf): where each row's symbol stands in the first column."""
    first = c_array(transform).select("code", "smaller")
    inside = Window.partitionBy("block", "code").orderBy("row")
    ranked = transform.withColumn("block", F.floor(F.col("row") / block)).withColumn("k", F.row_number().over(inside) - 1)
    return ranked.join(occ_checkpoints(transform, block), ["block", "code"]).join(F.broadcast(first), "code").select("row", "code", (F.col("smaller") + F.col("before") + F.col("k")).alias("lf"))


def inverse_bwt(transform: DataFrame) -> DataFrame:
    """(text_pos, code) of a text with one end mark, by doubling jumps along the LF mapping."""
    n = transform.count()
    jump = cut(lf_mapping(transform).select("row", "lf", F.when(F.col("row") == 0, 0).otherwise(1).alias("steps")))
    to_zero = cut(jump.select("row", F.when(F.col("row") == 0, F.lit(0)).otherwise(F.col("lf")).alias("next"), "steps"))
    h = 1
    while h < n:
        there = to_zero.select(F.col("row").alias("next"), F.col("next").alias("then"), F.col("steps").alias("more"))
        to_zero = cut(to_zero.join(there, "next").select("row", F.col("then").alias("next"), (F.col("steps") + F.col("more")).alias("steps")))
        h *= 2
    # Row 0 is the suffix of the end mark alone; a row that is `steps` jumps from it starts at steps - 1.
    return to_zero.join(transform, "row").select(F.pmod(F.col("steps") - 2, F.lit(n)).cast("long").alias("text_pos"), "code").orderBy("text_pos")


def sampled(sa: DataFrame, symbols: DataFrame, rate: int = 32) -> DataFrame:
    """(row, text_pos) of every rate-th text position and of each sequence's start."""
    return sa.join(symbols.select("text_pos", "is_start"), "text_pos").filter((F.col("text_pos") % rate == 0) | F.col("is_start")).select("row", "text_pos")


def resolve(rows: DataFrame, samples: DataFrame, lf: DataFrame) -> DataFrame:
    """(row, text_pos) of any rows of the suffix array, by steps of the LF mapping to a sampled row.

    Steps are doubled for the whole mapping, so there are as many joins as the sampling rate has bits.  A row that has come
    to one whose place is known takes its own place from there, and only goes on as one that others come to.
    """
    spark = lf.sparkSession
    cut(spark.range(1))  # names the shared folder
    place, step = f"{spark.sparkContext.getCheckpointDir()}/resolve-{uuid.uuid4().hex}", 0

    def written(df: DataFrame) -> DataFrame:
        """df as Parquet, a fraction of a checkpoint's size; the step before the last one is no longer read."""
        df.write.parquet(f"{place}/{step}")
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/{step - 1}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        return spark.read.schema(df.schema).parquet(f"{place}/{step}")

    known = samples.select("row", F.col("text_pos").alias("known"))
    arrived = F.col("known").isNotNull()
    start = lf.select("row", "lf").join(known, "row", "left")
    jump = written(start.select("row", F.when(~arrived, F.col("lf")).alias("at"), F.when(~arrived, 1).alias("steps"), "known"))
    while not (live := jump.filter(~arrived)).isEmpty():
        then = jump.select(F.col("row").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("known").alias("there"))
        moved = live.select("row", "at", "steps").join(then, "at").select(
            "row", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("there") + F.col("steps")).alias("known"))
        step += 1
        jump = written(jump.filter(arrived).unionByName(moved))
        spark.sparkContext._jvm.System.gc()  # lets Spark drop the shuffles of the step
    return rows.select("row").distinct().join(jump.select("row", F.col("known").alias("text_pos")), "row")


def kmer_table(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n): counts of all literal ACGT windows of k symbols."""
    return kmers(seqs, ["seq_id"], "seq", k, "pos").filter(concrete(F.col("kmer"))).groupBy("kmer").agg(F.count("*").alias("n"))


def kmer_intervals(seqs: DataFrame, sa: DataFrame | None, k: int) -> DataFrame:
    """(kmer, lo, hi): the rows of the suffix array whose suffixes begin with each literal ACGT window of k symbols.

    Rows are numbered by counting, so the suffix array itself isn't read: the first row of a k-mer is the number of suffixes
    that begin with less, for which a suffix counts up to its end mark.
    """
    marked = seqs.select("seq_id", F.concat("seq", F.lit("$" * k)).alias("seq"))
    counted = kmers(marked, ["seq_id"], "seq", k, "pos").groupBy(coded(F.col("kmer")).alias("key")).agg(F.count("*").alias("n"))
    placed = prefix_sum(counted, ["key"], "n", "lo").withColumn("kmer", decoded(F.col("key")))
    return placed.filter(concrete(F.col("kmer"))).select("kmer", "lo", (F.col("lo") + F.col("n")).alias("hi"))


def lookup(table: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (kmer) with lo and hi: an empty interval for a literal k-mer that doesn't occur, null for one with other symbols."""
    known = F.when(concrete(F.col("kmer")), F.lit(0).cast("long"))
    return asked.join(table, "kmer", "left").select("kmer", F.coalesce("lo", known).alias("lo"), F.coalesce("hi", known).alias("hi"))


def merge_intervals(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, lo, hi: half-open intervals with those that overlap or touch made one."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = intervals.withColumn("new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1)))
    return fresh.withColumn("run", F.sum("new").over(order)).groupBy(*keys, "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")
