"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into `segments` pieces.  With at most `distance` differing bits and
distance < 2 * segments, one piece differs in at most one bit, so two linked fingerprints share a
variant of that piece in which one position is a wildcard.  Variants are equi-joined and the full
distance is verified inside the join, which keeps each link once: in its first close piece, and,
where that piece is equal, in its first wildcard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name
from .components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Fingerprint of one whole text, unsigned; 0 if it has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    hashes = np.array([digest(join(words[i : i + shingle]), seed) for i in range(n)], "<u8").view("u1").reshape(-1, 8)
    ones = np.zeros(BITS, "i8")
    for at in range(0, n, 8192):
        ones += np.unpackbits(hashes[at : at + 8192], axis=1, bitorder="little").sum(0, dtype="i4")
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, *keys: str) -> DataFrame:
    """(doc_id, fp, *keys): the fingerprint of every row's whole text as a signed long, and string columns that come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column(1)], "u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view("i8")), *batch.columns[2:]], ["doc_id", "fp", *keys])

    schema = ", ".join(["doc_id long", "fp long", *(f"{k} string" for k in keys)])
    return docs.select(F.col("doc_id").cast("long"), "text", *keys).mapInArrow(run, schema)


def _cuts(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each piece; the wider ones come first."""
    wide = BITS % segments
    sizes = [BITS // segments + (i < wide) for i in range(segments)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def _piece(value: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1))


def links(prints: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """(u, v), u < v: every pair of distinct values of column fp that differ in 1 to `distance` bits."""
    if distance >= 2 * segments:
        raise ValueError("a piece would differ in more than one bit: distance must be under 2 * segments")
    pieces = _cuts(segments)
    wild = F.array(*[
        F.struct(F.lit(first + j).alias("wild"), _piece(F.col("fp"), first, width).bitwiseAND(F.lit(~(1 << j))).alias("rest"))
        for first, width in pieces for j in range(width)
    ])
    variants = prints.select("fp").distinct().select("fp", F.inline(wild))
    a, b = variants.alias("a"), variants.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first_close = F.lit(False)
    for k, (first, width) in reversed(list(enumerate(pieces))):
        here = (F.col("a.wild") >= first) & (F.col("a.wild") < first + width)
        once = here & ((_piece(differ, first, width) != 0) | (F.col("a.wild") == first))
        first_close = F.when(F.bit_count(_piece(differ, first, width)) <= 1, once).otherwise(first_close)
    on = (
        (F.col("a.wild") == F.col("b.wild")) & (F.col("a.rest") == F.col("b.rest"))
        & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= distance) & first_close
    )
    # Spark sizes the variants like the fingerprints they are made of, a 64th of what they take, and would broadcast them.
    return a.hint("merge").join(b, on).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def near_duplicates(docs: DataFrame, distance: int = 4, segments: int = 3, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    docs needs doc_id and text; other columns are ignored.  Null, empty and wordless texts have
    fingerprint 0 and link like any other; equal fingerprints are one node, so copies of any number add
    no link.  component_id is the smallest doc_id of the component (null ids are passed over; null
    if it has no other).  Repeated rows stay repeated; an empty table gives an empty one.
    """
    prints = cut(fingerprints(docs, shingle, seed))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    named = _least(nodes, connected_components(links(nodes, distance, segments)), "least_id")
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def _least(nodes: DataFrame, roots: DataFrame, column: str, salts: int = 32) -> DataFrame:
    """(fp, least): the smallest value of column in the component of each of nodes (fp, column).

    A node without links is its own component.  The others meet their component's value under one of `salts` keys,
    so that a component of any size is dealt over tasks.  Spark doesn't count the salts when it sizes the values, so the join is named.
    """
    linked = cut(nodes.join(roots, nodes.fp == roots.node).select("fp", column, "root"))
    found = linked.groupBy("root").agg(F.min(column).alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = linked.select("fp", "root", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int").alias("salt"))
    alone = nodes.join(roots, nodes.fp == roots.node, "left_anti").select("fp", F.col(column).alias("least"))
    return salted.join(found.hint("merge"), ["root", "salt"]).select("fp", "least").unionByName(alone)


def keep_one(docs: DataFrame, **options: int) -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id (null last), then the smallest hash of its text.

    Rows are told apart by doc_id and text, so rows that share an id, or have none, stay unless they are near copies.
    Null, empty and wordless texts are copies of each other.  All columns stay, whatever their names.
    """
    distance, segments = options.get("distance", 4), options.get("segments", 3)
    name = free_name(docs, "text_hash")
    keyed = docs.withColumn(name, F.coalesce(F.sha2("text", 256), F.lit("")))
    prints = cut(fingerprints(keyed, options.get("shingle", 4), options.get("seed", 42), name).withColumnRenamed(name, "hash"))
    nodes = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("first")))
    roots = connected_components(links(nodes, distance, segments))
    alone = nodes.join(roots, nodes.fp == roots.node, "left_anti").select("first")
    together = nodes.join(roots, nodes.fp == roots.node).groupBy("root").agg(F.min("first").alias("first")).select("first")
    keep = alone.unionByName(together).select(F.col("first.doc_id").alias("_kept"), F.col("first.hash").alias("_kept_hash"))
    same = keyed["doc_id"].eqNullSafe(keep["_kept"]) & (keyed[name] == keep["_kept_hash"])
    return keyed.join(keep, same, "left_semi").dropDuplicates(["doc_id", name]).drop(name)
