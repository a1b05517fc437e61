"""Sequences and reads from tables and from FASTA text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandframe.functions.iupac import SequenceError, first_invalid, normalise


def project(df: DataFrame, id_col: str, text_col: str, letters: str = "ACGT", name: str = "seq_id", value: str = "seq") -> DataFrame:
    """Letters of an alphabet kept from a text column, upper-cased; rows that are left empty go."""
    kept = F.upper(F.regexp_replace(text_col, f"[^{letters}{letters.lower()}]", ""))
    return df.select(F.col(id_col).alias(name), kept.alias(value)).filter(F.length(value) > 0)


def references(spark: SparkSession, sf_dir: str, letters: str = "ACGT") -> DataFrame:
    """(seq_id, header, seq) from documents."""
    return with_headers(project(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", letters))


def reads(spark: SparkSession, sf_dir: str, letters: str = "ACGT") -> DataFrame:
    """(query_id, pattern) from benchmark."""
    return project(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", letters, "query_id", "pattern")


def with_headers(seqs: DataFrame) -> DataFrame:
    """(seq_id, header, seq); a missing or empty header becomes seq_ and the id."""
    given = F.col("header") if "header" in seqs.columns else F.lit(None).cast("string")
    return seqs.select("seq_id", F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit("seq_"), "seq_id")).alias("header"), "seq")


def validate(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): good sequences in upper case; rejected rows with bad_offset, null where empty or null."""
    checked = seqs.withColumn("bad_offset", first_invalid(F.col("seq")))
    bad = F.col("seq").isNull() | (F.length("seq") == 0) | F.col("bad_offset").isNotNull()
    return checked.filter(~bad).drop("bad_offset").withColumn("seq", normalise(F.col("seq"))), checked.filter(bad)


def require_valid(seqs: DataFrame) -> DataFrame:
    """seqs in upper case; fails the job at the first empty or invalid sequence."""
    at = first_invalid(F.col("seq"))
    told = F.concat(F.lit("invalid character at offset "), at.cast("string"))
    return seqs.withColumn("seq", F.when(F.coalesce(F.length("seq"), F.lit(0)) == 0, F.raise_error("empty sequence").cast("string")).when(
        at.isNotNull(), F.raise_error(told).cast("string")).otherwise(normalise(F.col("seq"))))


def parse_fasta(files: DataFrame) -> DataFrame:
    """(path, record, header, seq) of files (path, value = the whole text).

    Lines are trimmed and blank ones skipped; a line with > starts a record whose header is the rest; lines
    before any header are sequences of their own; records without a body are dropped; record, which is a block
    of the file and a line in it, follows the order in the file.
    """
    return _records(files.select("path", F.lit(0).cast("long").alias("block"), F.posexplode(F.split("value", "\n")).alias("line", "value")).withColumn("line", F.col("line").cast("long")))


def _records(lines: DataFrame) -> DataFrame:
    """Records of (path, block, line, value), line rising inside a block.

    The last header is looked for inside blocks, then carried over the few blocks of a file.
    """
    lines = lines.withColumn("value", F.trim(F.regexp_replace("value", r"[\r\t]", " "))).filter("value <> ''")
    is_head = F.col("value").startswith(">")
    at = F.when(is_head, F.struct("block", "line"))
    run = Window.partitionBy("path", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = lines.groupBy("path", "block").agg(F.max(at).alias("last")).select("path", "block", F.max("last").over(before).alias("carried"))
    marked = lines.withColumn("record", F.max(at).over(run)).join(carried, ["path", "block"]).withColumn("record", F.coalesce("record", "carried", F.struct("block", "line")))
    parts = F.collect_list(F.when(~is_head, F.struct("block", "line", "value")))
    header = F.max(F.when(is_head, F.trim(F.expr("substring(value, 2)"))))
    return (
        marked.groupBy("path", "record").agg(header.alias("header"), F.array_join(F.transform(F.array_sort(parts), lambda x: x["value"]), "").alias("seq"))
        .filter(F.length("seq") > 0).select("path", "record", F.coalesce("header", F.lit("")).alias("header"), "seq")
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of the FASTA files under path, read by lines, so that a file of any size is dealt over tasks; fails if there are none.

    A record is one row, so a sequence has less than 2 GB.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    found = _records(lines)
    if found.isEmpty():
        raise SequenceError(f"no sequences in {path}")
    return found


def offsets(seqs: DataFrame) -> DataFrame:
    """seqs with len and start, the offset in the text that joins all by seq_id with one end mark each.

    Prefix sums are taken inside blocks of ids and over the block totals, so no task holds all rows.
    """
    block = F.floor(F.col("seq_id") / 4096)
    sized = seqs.withColumn("len", F.length("seq").cast("long")).withColumn("_block", block)
    totals = sized.groupBy("_block").agg(F.sum(F.col("len") + 1).alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_block").orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)
    return sized.join(base, "_block").withColumn("start", F.col("_base") + F.coalesce(F.sum(F.col("len") + 1).over(inside), F.lit(0))).drop("_block", "_base")
