"""Counting and locating patterns in sequences.

Whatever looks at positions first cuts each sequence, in one linear pass, into pieces that carry the start
of the next one, and deals the pieces out; so work grows with the length of the text, and one long sequence
occupies all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from strandframe.functions.iupac import BASES, SYMBOLS, Alphabet, compatible, let, mask, normalise, pattern_regex

PIECE = 2048
FEW = 1 << 20  # symbols of a batch of patterns that may be broadcast with their seeds
LIGHT = 6  # a seed of at most 2**LIGHT readings is joined by them
LONG = 15  # symbols whose masks fit in one long
WIDEST = 2 * LONG  # the longest seed with ambiguity codes


def occurrences(seq: Column, pattern: str, alphabet: Alphabet = "iupac") -> Column:
    """Overlapping occurrences in one sequence; an empty pattern occurs at every place and the end."""
    if pattern == "":
        return (F.length(seq) + 1).cast("long")
    regex = pattern_regex(pattern, alphabet)
    return F.lit(0).cast("long") if regex is None else F.regexp_count(seq, F.lit(f"(?={regex})")).cast("long")


def count(refs: DataFrame, pattern: str, alphabet: Alphabet = "iupac") -> DataFrame:
    """(n): occurrences over all sequences, 0 for none."""
    return refs.agg(F.coalesce(F.sum(occurrences(F.col("seq"), pattern, alphabet)), F.lit(0)).cast("long").alias("n"))


def pieces(df: DataFrame, keys: list[str], text: Column, more: int = 0, size: int = PIECE) -> DataFrame:
    """keys, _base, _piece: the symbols from place _base on, `size` of them and the `more` that follow."""
    size = max(size, more, 1)
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    after = lambda all, i: F.coalesce(F.substring(F.get(all, i + 1), 1, more), F.lit(""))
    each = let(parts, lambda all: F.transform(all, lambda x, i: F.struct((i * size).alias("_base"), (F.concat(x, after(all, i)) if more else x).alias("_piece"))))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*keys, F.inline(each)).repartition(n, *keys, "_base")


def locate(refs: DataFrame, pattern: str, alphabet: Alphabet = "iupac") -> DataFrame:
    """(seq_id, header, pos) of all occurrences, 0-based; another column named start is carried."""
    carried = [c for c in ("seq_id", "header", "start") if c in refs.columns]
    regex = pattern_regex(pattern, alphabet)
    if regex is None:
        return refs.select(*carried, F.lit(0).alias("pos")).filter("false")
    if pattern == "":
        cut = pieces(refs, carried, F.concat("seq", F.lit("$")))
        each = cut.select(*carried, "_base", F.explode(F.sequence(F.lit(0), F.length("_piece") - 1)).alias("_at"))
        return each.select(*carried, (F.col("_base") + F.col("_at")).cast("int").alias("pos"))
    # Every symbol that an occurrence starts with becomes a mark.
    cut = pieces(refs.filter(F.col("seq").rlike(regex)), carried, F.col("seq"), len(pattern) - 1)
    marked = F.regexp_replace("_piece", f"(?={regex}).", "!")
    each = cut.withColumn("_piece", marked).filter(F.col("_piece").contains("!")).select(*carried, "_base", F.posexplode(F.split("_piece", "")).alias("_at", "_symbol"))
    return each.filter("_symbol = '!'").select(*carried, (F.col("_base") + F.col("_at")).cast("int").alias("pos"))


def positions(refs_with_start: DataFrame, pattern: str, alphabet: Alphabet = "iupac") -> DataFrame:
    """(text_pos): offsets in the joined text."""
    return locate(refs_with_start, pattern, alphabet).select((F.col("start") + F.col("pos")).alias("text_pos"))


def kmers(df: DataFrame, keys: list[str], text: str, k: int, pos: str) -> DataFrame:
    """keys, kmer and its 0-based place for all windows of k symbols."""
    windows = F.regexp_extract_all("_piece", F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    each = pieces(df, keys, F.col(text), k - 1).select(*keys, "_base", F.posexplode(windows).alias("_at", "kmer"))
    return each.select(*keys, "kmer", (F.col("_base") + F.col("_at")).cast("int").alias(pos))


def concrete(kmer: Column) -> Column:
    return kmer.rlike("^[ACGT]+$")


def few(patterns: DataFrame) -> bool:
    """Whether a batch (pattern) has at most FEW symbols."""
    return (patterns.agg(F.sum(F.length("pattern"))).first()[0] or 0) <= FEW


def scanned(patterns: DataFrame, step: int = 0) -> list | None:
    """The different patterns, without null and empty ones, if they are few enough to be looked for at every place; else None.

    step: how far apart their seeds are, 0 for one seed each.
    """
    try:
        from . import scan  # needs numpy and pyarrow
    except ModuleNotFoundError:
        return None
    seeds = F.lit(1) if not step else F.floor(F.length("pattern") / step) + 1
    asked = patterns.filter("pattern <> ''").select("pattern").distinct()
    n, symbols = asked.agg(F.sum(seeds), F.sum(F.length("pattern"))).first()
    return [r[0] for r in asked.collect()] if (n or 0) <= scan.MOST_SEEDS and (symbols or 0) <= scan.MOST_SYMBOLS else None


def askers(patterns: DataFrame, texts: list[str]) -> DataFrame:
    """(which, query_id): the queries that ask for each of the different texts."""
    listed = patterns.sparkSession.createDataFrame(list(enumerate(texts)), "which int, pattern string")
    return patterns.join(F.broadcast(listed), "pattern").select("which", "query_id")


def matching(asked: DataFrame, held: DataFrame, k: int, alphabet: Alphabet) -> DataFrame:
    """(kmer, found): pairs of matching k-mers, each once, of two tables of different k-mers.

    Two k-mers match under IUPAC exactly if they share a concrete reading.  Those of few readings are joined by
    these; the rest, of which a run of Ns gives one only, are compared with all by their packed masks.
    """
    if not isinstance(alphabet, str):
        regex = F.array_join(F.transform(F.split("kmer", ""), lambda c: F.coalesce(F.try_element_at(_classes(alphabet), c), F.lit(""))), "")
        rules = asked.select("kmer", F.concat(F.lit("^"), regex, F.lit("$")).alias("_rule"))
        return rules.join(held.select(F.col("kmer").alias("found")), F.expr("found rlike _rule")).select("kmer", "found")
    if k > WIDEST:
        raise ValueError(f"seeds of ambiguity codes have at most {WIDEST} symbols")
    codes = lambda regex: F.length("kmer") - F.length(F.regexp_replace("kmer", regex, ""))
    light = 2 * codes("[NBDHV]") + codes("[RYSWKM]") <= LIGHT
    read = lambda df, name: df.filter(light).select(F.col("kmer").alias(name), F.explode(_readings(F.col("kmer"))).alias("_reading"))
    by_reading = read(asked, "kmer").join(read(held, "found"), "_reading").select("kmer", "found").distinct()
    masked = F.translate("kmer", "".join(BASES), "".join(f"{mask(s):X}" for s in BASES))
    parts = [(at, min(LONG, k - at)) for at in range(0, k, LONG)]
    packed = lambda name: [F.conv(F.substring(masked, at + 1, n), 16, 10).cast("long").alias(f"{name}{at}") for at, n in parts]
    a = asked.select("kmer", *packed("_a"), light.alias("_light"))
    b = held.select(F.col("kmer").alias("found"), *packed("_b"), light.alias("_both"))

    def meet(at: int, n: int) -> Column:
        """Whether no place of a part is empty in both."""
        shared, ones = F.col(f"_a{at}").bitwiseAND(F.col(f"_b{at}")), F.lit(int("1" * n, 16))
        return reduce(Column.bitwiseOR, [F.shiftright(shared, i) for i in range(4)]).bitwiseAND(ones) == ones

    some = reduce(Column.__and__, [meet(at, n) for at, n in parts])
    left, right = a.filter("not _light").join(b, some), a.filter("_light").join(b.filter("not _both"), some)
    return by_reading.unionByName(left.unionByName(right).select("kmer", "found"))


def _classes(alphabet: Alphabet) -> Column:
    pairs = [(s, compatible(s, alphabet)) for s in SYMBOLS[1:]]
    return F.create_map(*[F.lit(x) for s, c in pairs for x in (s, f"[{c}]" if c else "(?!)")])


def _readings(kmer: Column) -> Column:
    symbols = F.filter(F.split(kmer, ""), lambda c: c != "")
    choices = F.create_map(*[x for s, b in BASES.items() for x in (F.lit(s), F.array(*map(F.lit, b)))])
    return F.aggregate(symbols, F.array(F.lit("")), lambda heads, c: F.flatten(F.transform(heads, lambda h: F.transform(F.try_element_at(choices, c), lambda b: F.concat(h, b)))))


def seed_hits(asked: DataFrame, refs: DataFrame, k: int, alphabet: Alphabet, small: bool) -> DataFrame:
    """(query_id, i, seq_id, p): every place p where the seed (query_id, i, kmer) of k symbols matches, each once.

    small: the seeds may be broadcast; else both sides are dealt out by k-mer.
    """
    narrow = F.broadcast if small else lambda df: df
    places = kmers(refs, ["seq_id"], "seq", k, "p")
    if alphabet == "exact":
        return places.join(narrow(asked.filter(concrete(F.col("kmer")))), "kmer").select("query_id", "i", "seq_id", "p")
    valid = F.col("kmer").rlike(f"^[{SYMBOLS[1:]}]+$")
    known = places.filter(valid)
    pairs = matching(narrow(asked.filter(valid).select("kmer").distinct()), known.select("kmer").distinct(), k, alphabet)
    return known.withColumnRenamed("kmer", "found").join(pairs, "found").join(narrow(asked), "kmer").select("query_id", "i", "seq_id", "p")


def locate_many(refs: DataFrame, patterns: DataFrame, k: int = 8, alphabet: Alphabet = "exact") -> DataFrame:
    """(query_id, seq_id, pos) of every pattern, as locate finds them one by one.

    refs (seq_id, seq), patterns (query_id, pattern), read in upper case with U as T.  A pattern is tiled with seeds
    of k symbols, of its own length if that is shorter; it stands where all its tiles match on one diagonal.
    k never changes the result.  An empty pattern stands at every place and the end; a null one nowhere.
    A few patterns with ambiguity codes are looked for at every place instead.
    """
    patterns = patterns.select("query_id", normalise(F.col("pattern")).alias("pattern"))
    if alphabet == "iupac" and (texts := scanned(patterns)) is not None:
        return _scanned_places(refs, patterns, texts)
    k = min(k, WIDEST) if alphabet != "exact" else k
    small = few(patterns)
    # At most k + 1 different lengths of seeds.
    lengths = sorted(r[0] for r in patterns.select(F.least(F.length("pattern"), F.lit(k))).distinct().collect() if r[0] is not None)
    found = []
    for n in lengths:
        own = patterns.filter(F.least(F.length("pattern"), F.lit(k)) == n)
        if n == 0:
            found.append(own.select("query_id").crossJoin(locate(refs, "").select("seq_id", "pos")))
            continue
        last = F.length("pattern") - n
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(n)), F.array(last)))
        tiled = own.select("query_id", "pattern", F.size(starts).alias("n_tiles"), F.explode(starts).alias("i"))
        tiles = tiled.select("query_id", "n_tiles", "i", F.substring(F.col("pattern"), F.col("i") + 1, F.lit(n)).alias("kmer"))
        hits = seed_hits(tiles.drop("n_tiles"), refs, n, alphabet, small)
        one = tiles.groupBy("query_id").agg(F.max("n_tiles").alias("n_tiles"))
        whole = hits.groupBy("query_id", "seq_id", (F.col("p") - F.col("i")).alias("pos")).agg(F.count("*").alias("n")).join(F.broadcast(one) if small else one, "query_id")
        found.append(whole.filter("n = n_tiles and pos >= 0").select("query_id", "seq_id", "pos"))
    if not found:
        return refs.select(F.lit(None).cast(dict(patterns.dtypes)["query_id"]).alias("query_id"), "seq_id", F.lit(0).alias("pos")).filter("false")
    return reduce(DataFrame.unionByName, found)


def _scanned_places(refs: DataFrame, patterns: DataFrame, texts: list[str]) -> DataFrame:
    """locate_many of the different texts, and of the empty ones among patterns."""
    from . import scan

    empty = patterns.filter("pattern = ''").select("query_id")
    everywhere = empty.crossJoin(locate(refs, "").select("seq_id", "pos"))
    if not texts:
        return everywhere
    pieced, size = scan.laid(refs, texts)
    names = askers(patterns, texts)
    found = scan.locate(pieced, texts, size).join(F.broadcast(names) if few(patterns) else names, "which").select("query_id", "seq_id", "pos")
    return found if empty.isEmpty() else found.unionByName(everywhere)


def map_position(refs_with_start: DataFrame, text_positions: DataFrame) -> DataFrame:
    """(text_pos, seq_id, pos) for offsets inside the joined text; the end mark maps to pos = len.

    The range join is an equi-join on blocks of 65,536 offsets, which each sequence is listed under.
    """
    block = 65536
    ranges = refs_with_start.select("seq_id", "start", "len", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("len")) / block))).alias("block"))
    asked = text_positions.withColumn("block", F.floor(F.col("text_pos") / block))
    inside = (F.col("text_pos") >= F.col("start")) & (F.col("text_pos") <= F.col("start") + F.col("len"))
    return asked.join(ranges, "block").filter(inside).select("text_pos", "seq_id", (F.col("text_pos") - F.col("start")).cast("int").alias("pos"))


class HitSet:
    """Occurrences (seq_id, begin, end) of one literal pattern, grown by a symbol at either end."""

    def __init__(self, refs: DataFrame, hits: DataFrame):
        self.refs, self.hits = refs, hits

    @classmethod
    def of(cls, refs: DataFrame, pattern: str = "") -> HitSet:
        found = locate(refs, pattern, "exact") if pattern else locate(refs, "")
        return cls(refs, found.select("seq_id", F.col("pos").alias("begin"), (F.col("pos") + len(pattern)).alias("end")))

    def _grown(self, symbol: str, at: Column, begin: Column, end: Column) -> HitSet:
        literal = {s: s for s in SYMBOLS[1:]}
        there = locate(self.refs, symbol, literal).select("seq_id", F.col("pos").alias("_at"))
        near = self.hits.withColumn("_at", at).join(there, ["seq_id", "_at"])
        return HitSet(self.refs, near.select("seq_id", begin.alias("begin"), end.alias("end")))

    def extend_right(self, symbol: str) -> HitSet:
        return self._grown(symbol, F.col("end"), F.col("begin"), F.col("end") + 1)

    def extend_left(self, symbol: str) -> HitSet:
        return self._grown(symbol, F.col("begin") - 1, F.col("begin") - 1, F.col("end"))

    def count(self) -> DataFrame:
        return self.hits.agg(F.count("*").alias("n"))

    def is_empty(self) -> bool:
        return self.hits.isEmpty()

    def locate(self) -> DataFrame:
        return self.hits.select("seq_id", F.col("begin").cast("int").alias("pos"))
