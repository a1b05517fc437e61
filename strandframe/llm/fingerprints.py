"""Homomorphic multiset fingerprints of documents, in DataFrame expressions only.

A paragraph is hashed to a wide vector and a document's fingerprint is the sum of its paragraphs'
vectors modulo powers of two, so it depends neither on their order nor on how they were added, and a
paragraph is inserted or deleted by adding or subtracting its vector.  Lanes 0 to EXACT - 1 sum
hashes of whole paragraphs modulo 2**32 and decide equality; the other SKETCH lanes count, with a
hashed sign, the paragraph's runs of up to three words modulo 2**16, and their cosine estimates likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EXACT, SKETCH = 8, 128
#: Blocks of scripts without blanks (Thai, Lao, Myanmar, Khmer, Chinese, Japanese).
UNBROKEN = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\u2FDF\u3005-\u3007\u3021-\u30FF\u31F0-\u31FF\u3400-\u9FFF\uF900-\uFAFF\uFF66-\uFF9D\x{20000}-\x{3FFFF}"
#: Up to 16 characters between blanks, or a letter of such a script.
WORD = rf"[^\s{UNBROKEN}]{{1,16}}|[{UNBROKEN}]"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def vector(text: Column) -> Column:
    """Fingerprint of a text as an array of EXACT + SKETCH longs; lines are paragraphs."""
    def exact(paragraphs: Column) -> Column:
        added = lambda k: F.aggregate(paragraphs, F.lit(0).cast("long"), lambda t, p: (t + F.xxhash64(k, p).bitwiseAND(F.lit(0xFFFFFFFF))).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.transform(F.sequence(F.lit(0), F.lit(EXACT - 1)), added)

    def runs(line: Column) -> Column:
        """A hash for each word with the two after it, or as many as the line has."""
        words = F.regexp_extract_all(line, F.lit(WORD), F.lit(0))
        return _let(words, lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(2 * SKETCH - 1).cast("long")).cast("int")))

    def sketch(codes: Column, shift: int) -> Column:
        """Signed counts; the last bit of a code is its sign. Codes are parted four ways, time and again, then counted."""
        if shift == 0:
            count = lambda k: F.size(F.filter(codes, lambda x: x.bitwiseAND(F.lit(3)) == k)).cast("long")
            return F.transform(F.sequence(F.lit(0), F.lit(1)), lambda j: _wrap(count(j * 2) - count(j * 2 + 1), 16))
        part = lambda j: F.filter(codes, lambda x: F.shiftright(x, shift).bitwiseAND(F.lit(3)) == j)
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: _let(part(j), lambda some: sketch(some, shift - 2))))

    lines = F.split(text, "\n")
    return F.concat(_let(lines, exact), _let(F.flatten(F.transform(lines, runs)), lambda codes: sketch(codes, SKETCH.bit_length() - 2)))


def _wrap(value: Column, bits: int) -> Column:
    return F.pmod(value, F.lit(1 << bits))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Vector of the paragraphs of both (sign 1), or of a without those of b (sign -1)."""
    summed = F.zip_with(a, b, lambda x, y: x + y * sign)
    return F.transform(summed, lambda x, i: F.when(i < EXACT, _wrap(x, 32)).otherwise(_wrap(x, 16)))


def as_text(vector: Column) -> Column:
    """Hexadecimal: 8 digits for each exact lane, 4 for each sketch lane."""
    return F.array_join(F.transform(vector, lambda x, i: F.lpad(F.lower(F.hex(x)), F.when(i < EXACT, 8).otherwise(4), "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal exact lanes, else the cosine of the sketch lanes, 0 to 1."""
    signed = lambda v: F.transform(F.slice(v, EXACT + 1, SKETCH), lambda x: F.when(x >= 1 << 15, x - (1 << 16)).otherwise(x).cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    sums = lambda s: F.struct(dot(s["a"], s["b"]).alias("ab"), F.sqrt(dot(s["a"], s["a"]) * dot(s["b"], s["b"])).alias("size"))
    cosine = lambda d: F.when(d["size"] > 0, F.least(F.greatest(d["ab"] / d["size"], F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    near = _let(_let(F.struct(signed(a).alias("a"), signed(b).alias("b")), sums), cosine)
    return F.when(F.slice(a, 1, EXACT) == F.slice(b, 1, EXACT), 1.0).otherwise(near)


def _ranges(docs: DataFrame, rows_per_range: int) -> Column:
    """Number of a document's range: equal widths of ids if these hold about equally many rows, else quantiles of the ids."""
    ids = docs.agg(F.min("doc_id").cast("double").alias("lo"), F.max("doc_id").cast("double").alias("hi"), F.count("*").alias("n")).first()
    parts = -(-ids["n"] // rows_per_range)
    if parts <= 1 or ids["lo"] is None or ids["lo"] == ids["hi"]:
        return F.lit(0)
    width = max(1.0, (ids["hi"] - ids["lo"] + 1) / parts)
    part = F.coalesce(F.floor((F.col("doc_id").cast("double") - ids["lo"]) / width), F.lit(-1)).cast("long")
    if docs.groupBy(part.alias("part")).count().agg(F.max("count")).first()[0] <= 8 * rows_per_range:
        return part
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / parts for k in range(1, min(parts, 2000))], 0.25 / min(parts, 2000))})
    return F.aggregate(F.array(*[F.lit(x) for x in cuts]), F.lit(0), lambda t, x: t + F.coalesce((F.col("doc_id") >= x).cast("int"), F.lit(0)))


def with_edits(docs: DataFrame, rows_per_range: int = 4000) -> DataFrame:
    """Fingerprint of every document and of its text with the last half replaced from the next document.

    Columns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Documents are in ascending order of doc_id (null first, equal ids by their text's hash) and the first
    follows the last.  A null text counts as empty.  docs is dealt once, to ranges of ids of about
    rows_per_range rows, however many, and only each range's first document is handed to the range before.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = base.withColumn("part", _ranges(base, rows_per_range)).withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "tie", "text")

    first = keyed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "tie", "text")).alias("head"))
    # The ring of ranges is closed over their numbers alone; the texts meet them by a join.
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = keyed.select("part").distinct().select(F.col("part").alias("at"), F.coalesce(F.lead("part").over(ring), F.first("part").over(whole)).alias("next"))
    heads = after.join(first, after["next"] == first["part"]).select("at", F.col("head.text").alias("head_text"))

    ranked = keyed.withColumn("own", vector(F.col("text"))).withColumn("follows", F.lead("text").over(order)).withColumn("after", F.lead("own").over(order))
    half = F.floor(F.length("text") / 2).cast("int")
    joined = ranked.join(heads, (F.col("part") == F.col("at")) & F.col("follows").isNull(), "left")
    joined = joined.withColumn("follows", F.coalesce("follows", "head_text")).withColumn("after", F.coalesce("after", vector(F.col("head_text"))))
    edited = joined.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("follows"), F.lit(1), half)))
    both = edited.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "own", "after", vector(F.col("edited")).alias("changed"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
    )
