"""Registered queries of the sequence engine and the same in SQL, over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.functions import iupac
from strandframe.operators import index, mems, search
from strandframe.operators.search import HitSet
from strandframe.plans.index import SequenceIndex
from strandframe.sources import sequences as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MIN_LEN = 12


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def _refs(letters: str = "ACGT") -> str:
    return f"(SELECT doc_id AS seq_id, upper(regexp_replace(text, '[^{letters}{letters.lower()}]', '', 'g')) AS seq FROM documents)"


def _with(letters: str = "ACGT") -> str:
    return f"WITH r AS (SELECT * FROM {_refs(letters)} WHERE length(seq) > 0)"


def _windows(regex: str, m: int, letters: str = "ACGT") -> str:
    """Places where a window of m symbols matches a regular expression."""
    return f"""{_with(letters)}, w AS (SELECT seq_id, seq, unnest(range(0, length(seq) - {m - 1})) AS pos FROM r WHERE regexp_matches(seq, '{regex}')),
        h AS (SELECT seq_id, pos FROM w WHERE regexp_full_match(substr(seq, pos + 1, {m}), '{regex}'))"""


def _reads(letters: str = "ACGT") -> str:
    return f"q AS (SELECT * FROM (SELECT item_id AS query_id, upper(regexp_replace(text, '[^{letters}{letters.lower()}]', '', 'g')) AS pattern FROM benchmark) WHERE length(pattern) > 0)"


IUPAC = "ACGTNRYSWKMBDHV"
ACAC, MIXED = "ACAC", "ACRN"
MIXED_REGEX = "[ANRWMDHV][CNYSMBHV][AGNRSWKMBDHV][ACGTNRYSWKMBDHV]"
HEX_DIGITS = "0123456789ABCDEF"
HEX = "1248F5A69C3EDB7"  # masks of the codes, in the order of IUPAC
START = "SELECT seq_id, length(seq) AS len, coalesce(sum(length(seq) + 1) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r"


@register(f"""{_with(IUPAC)} SELECT sym, (instr('$ACGTNRYSWKMBDHV', sym) - 1)::INT AS code, count(*) AS n FROM (SELECT unnest(string_split(seq, '')) AS sym FROM r) GROUP BY sym""")
def encode_symbols(spark, sf_dir):
    refs = src.references(spark, sf_dir, IUPAC)
    each = refs.select(F.explode(F.split("seq", "")).alias("sym")).filter("sym <> ''")
    return each.groupBy("sym").agg(F.count("*").alias("n")).select("sym", iupac.code_of(F.col("sym")).alias("code"), "n")


@register("""WITH a(sym, m) AS (VALUES ('A',1),('C',2),('G',4),('T',8),('N',15),('R',5),('Y',10),('S',6),('W',9),('K',12),('M',3),('B',14),('D',13),('H',11),('V',7))
    SELECT p.sym AS q_sym, q.sym AS r_sym FROM a p JOIN a q ON (p.m & q.m) <> 0""")
def iupac_compat_pairs(spark, sf_dir):
    return iupac.compat_pairs(spark)


@register("""SELECT item_id AS seq_id, length(regexp_extract(text, '^[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]*'))::INT AS bad_offset FROM benchmark
    WHERE length(regexp_extract(text, '^[ACGTUNRYSWKMBDHVacgtunryswkmbdhv]*')) < length(text)""")
def validate_sequences(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("seq_id"), F.col("text").alias("seq"))
    return src.validate(rows)[1].select("seq_id", "bad_offset")


@register(f"{_with()} {START}")
def concat_offsets(spark, sf_dir):
    return src.offsets(src.references(spark, sf_dir)).select("seq_id", "len", "start")


@register(f"{_with()} SELECT header, length(seq)::INT AS len FROM (SELECT 'seq_' || seq_id AS header, seq FROM r)")
def sequence_headers(spark, sf_dir):
    return src.references(spark, sf_dir).select("header", F.length("seq").alias("len"))


@register(f"""{_with()}, t AS (SELECT unnest(string_split(seq || '$', '')) AS sym FROM r), n AS (SELECT instr('$ACGTNRYSWKMBDHV', sym) - 1 AS code, count(*) AS n FROM t GROUP BY 1)
    SELECT a.code::INT AS code, substr('$ACGTNRYSWKMBDHV', a.code::INT + 1, 1) AS sym, coalesce(n.n, 0)::BIGINT AS n,
    coalesce(sum(n.n) OVER (ORDER BY a.code ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS smaller FROM range(16) a(code) LEFT JOIN n USING (code)""")
def c_array(spark, sf_dir):
    return index.c_array(index.text(src.references(spark, sf_dir)))


@register(f"{_with(IUPAC)} SELECT seq_id, translate(seq, '{IUPAC}', '123456789ABCDEF') AS coded, seq AS decoded, reverse(seq) AS reversed FROM r")
def coded_sequences(spark, sf_dir):
    coded = src.references(spark, sf_dir, IUPAC).select("seq_id", iupac.coded(F.col("seq")).alias("coded"))
    return coded.withColumn("decoded", iupac.decoded(F.col("coded"))).withColumn("reversed", F.reverse("decoded"))


@register(f"{_with()}, o AS ({START}) SELECT seq_id, start::BIGINT AS start, (start + len)::BIGINT AS \"end\" FROM o")
def seq_boundaries(spark, sf_dir):
    return SequenceIndex.build(src.references(spark, sf_dir)).boundaries()


@register(f"""{_with()}, t AS (SELECT unnest(string_split(seq || '$', '')) AS sym FROM r) SELECT sym, count(*) AS n FROM t GROUP BY sym""")
def symbol_count(spark, sf_dir):
    return index.c_array(index.text(src.references(spark, sf_dir))).filter("n > 0").select("sym", "n")


@register(f"{_with()}, o AS ({START}) SELECT seq_id, 'seq_' || seq_id AS header, seq, len, start::BIGINT AS start FROM o JOIN r USING (seq_id)")
def index_roundtrip(spark, sf_dir):
    index.cut(spark.range(1))  # names the shared folder
    path = f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}"
    SequenceIndex.build(src.references(spark, sf_dir)).save(path)
    return SequenceIndex.load(spark, path).refs.select("seq_id", "header", "seq", "len", "start")


@register(f"{_with()} SELECT count(*) AS num_sequences, sum(length(seq) + 1)::BIGINT AS text_len FROM r")
def text_statistics(spark, sf_dir):
    return src.references(spark, sf_dir).agg(F.count("*").alias("num_sequences"), F.sum(F.length("seq") + 1).alias("text_len"))


ROUNDS = 20  # doubling ranks every suffix of up to 2**ROUNDS symbols


def _suffixes() -> str:
    """Common table expressions t (text_pos, code, is_start), sa ("row", text_pos) and b ("row", code)."""
    rounds = ", ".join(
        f"r{j + 1} AS MATERIALIZED (SELECT a.p, dense_rank() OVER (ORDER BY a.k, coalesce(b.k, 0)) AS k FROM r{j} a LEFT JOIN r{j} b ON b.p = a.p + {1 << j})" for j in range(ROUNDS)
    )
    return f"""{_with()}, o AS ({START}), y AS (SELECT start, unnest(string_split(seq || '$', '')) AS sym, generate_subscripts(string_split(seq || '$', ''), 1) - 1 AS i FROM o JOIN r USING (seq_id)),
        t AS MATERIALIZED (SELECT (start + i)::BIGINT AS text_pos, (instr('$ACGTNRYSWKMBDHV', sym) - 1)::INT AS code, i = 0 AS is_start FROM y),
        r0 AS MATERIALIZED (SELECT text_pos AS p, code + 1 AS k FROM t), {rounds},
        sa AS MATERIALIZED (SELECT k - 1 AS "row", p AS text_pos FROM r{ROUNDS}),
        f AS MATERIALIZED (SELECT CASE WHEN text_pos = max(text_pos) OVER () THEN 0 ELSE text_pos + 1 END AS text_pos, code FROM t),
        b AS MATERIALIZED (SELECT "row", code FROM sa JOIN f USING (text_pos))"""


@register(f"""{_suffixes()} SELECT "row"::BIGINT AS "row", text_pos FROM sa""")
def suffix_array(spark, sf_dir):
    return index.suffix_array(index.text(src.references(spark, sf_dir)))


def _ordered(spark, sf_dir):
    return index.ordered(index.text(src.references(spark, sf_dir)))


@register(f"""{_suffixes()} SELECT "row"::BIGINT AS "row", code FROM b""")
def bwt(spark, sf_dir):
    return index.transform_of(_ordered(spark, sf_dir))


@register(f"""{_suffixes()} SELECT "row"::BIGINT AS "row", code, (row_number() OVER (ORDER BY code, "row") - 1)::BIGINT AS lf FROM b""")
def lf_mapping(spark, sf_dir):
    return index.lf_of(_ordered(spark, sf_dir))


@register(f"""{_suffixes()}, c AS (SELECT "row" // 4096 AS block, code, count(*) AS n FROM b GROUP BY ALL),
    g AS (SELECT x.block, y.code, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT block FROM c) x CROSS JOIN (SELECT DISTINCT code FROM c) y LEFT JOIN c ON c.block = x.block AND c.code = y.code)
    SELECT block::BIGINT AS block, code, coalesce(sum(n) OVER (PARTITION BY code ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM g""")
def occ_checkpoints(spark, sf_dir):
    return index.occ_checkpoints_of(_ordered(spark, sf_dir))


@register(f"""{_suffixes()} SELECT c.code::INT AS code, ("row" + 1)::BIGINT AS i, sum((b.code = c.code)::INT) OVER (PARTITION BY c.code ORDER BY "row")::BIGINT AS rank FROM b CROSS JOIN range(5) c(code)""")
def occ_rank(spark, sf_dir):
    return index.ranks_of(_ordered(spark, sf_dir), list(range(5)))


@register(f"""{_suffixes()} SELECT "row"::BIGINT AS "row", text_pos FROM sa JOIN t USING (text_pos) WHERE text_pos % 32 = 0 OR is_start""")
def sampled_sa(spark, sf_dir):
    return index.sampled_of(_ordered(spark, sf_dir))


@register(f"""{_suffixes()} SELECT "row"::BIGINT AS "row", text_pos FROM sa""")
def resolve_sa(spark, sf_dir):
    return index.resolved_of(_ordered(spark, sf_dir))


@register(f"""{_suffixes()}, w AS (SELECT start + pos AS text_pos, substr(seq, pos + 1, 6) AS kmer FROM (SELECT start, seq, unnest(range(0, length(seq) - 5)) AS pos FROM o JOIN r USING (seq_id)))
    SELECT kmer, min("row")::BIGINT AS lo, (max("row") + 1)::BIGINT AS hi FROM w JOIN sa USING (text_pos) GROUP BY kmer""")
def kmer_intervals_k6(spark, sf_dir):
    return index.kmer_intervals(src.references(spark, sf_dir), None, 6)


INTERVALS = f"""{_suffixes()}, w AS (SELECT start + pos AS text_pos, substr(seq, pos + 1, 6) AS kmer FROM (SELECT start, seq, unnest(range(0, length(seq) - 5)) AS pos FROM o JOIN r USING (seq_id))),
    v AS MATERIALIZED (SELECT kmer, min("row")::BIGINT AS lo, (max("row") + 1)::BIGINT AS hi FROM w JOIN sa USING (text_pos) GROUP BY kmer)"""
READ_KMERS = "(SELECT DISTINCT substr(pattern, i + 1, 6) AS kmer FROM (SELECT pattern, unnest(range(0, length(pattern) - 5)) AS i FROM q))"


@register(f"""{INTERVALS}, {_reads("ACGTN")} SELECT kmer, CASE WHEN kmer NOT LIKE '%N%' THEN coalesce(v.lo, 0) ELSE -1 END AS lo, CASE WHEN kmer NOT LIKE '%N%' THEN coalesce(v.hi, 0) ELSE -1 END AS hi FROM {READ_KMERS} LEFT JOIN v USING (kmer)""")
def kmer_lookup_get(spark, sf_dir):
    asked = search.kmers(src.reads(spark, sf_dir, "ACGTN"), ["query_id"], "pattern", 6, "i").select("kmer").distinct()
    return index.lookup(index.kmer_intervals(src.references(spark, sf_dir), None, 6), asked).fillna(-1)


def _intervals(spark, sf_dir):
    spans = index.kmer_intervals(src.references(spark, sf_dir), None, 6)
    return index.transform_of(_ordered(spark, sf_dir)), index.cut(spans.select("lo", "hi", F.explode(F.array(*[F.lit(c) for c in range(1, 5)])).alias("code")))


@register(f"""{INTERVALS}, c AS MATERIALIZED (SELECT "row" + 1 AS i, c.code, sum((b.code = c.code)::INT) OVER (PARTITION BY c.code ORDER BY "row") AS n FROM b CROSS JOIN range(1, 5) c(code))
    SELECT a.code::INT AS code, lo, hi, coalesce(a.n, 0)::BIGINT AS rank_lo, z.n::BIGINT AS rank_hi FROM v JOIN c z ON z.i = hi LEFT JOIN c a ON a.i = lo AND a.code = z.code WHERE lo > 0""")
def rank_pairs_k6(spark, sf_dir):
    transform, asked = _intervals(spark, sf_dir)
    return index.rank_pairs(transform, index.cut(index.occ_checkpoints(transform)), asked)


@register(f"""{INTERVALS}, c AS MATERIALIZED (SELECT "row" + 1 AS i, c.code, sum((b.code < c.code)::INT) OVER (PARTITION BY c.code ORDER BY "row") AS n FROM b CROSS JOIN range(1, 5) c(code))
    SELECT z.code::INT AS code, lo, hi, (z.n - coalesce(a.n, 0))::BIGINT AS smaller FROM v JOIN c z ON z.i = hi LEFT JOIN c a ON a.i = lo AND a.code = z.code""")
def smaller_in_k6(spark, sf_dir):
    transform, asked = _intervals(spark, sf_dir)
    return index.smaller_in(transform, asked)


@register(f"{_with()} SELECT substr(seq, pos + 1, 6) AS kmer, count(*) AS n FROM (SELECT seq, unnest(range(0, length(seq) - 5)) AS pos FROM r) GROUP BY 1")
def kmer_lookup_k6(spark, sf_dir):
    return index.kmer_table(src.references(spark, sf_dir), 6)


@register(f"{_windows(ACAC, 4)} SELECT count(*) AS n FROM h")
def count_exact(spark, sf_dir):
    return search.count(src.references(spark, sf_dir), ACAC)


@register(f"{_windows(MIXED_REGEX, 4, IUPAC)} SELECT count(*) AS n FROM h")
def count_iupac(spark, sf_dir):
    return search.count(src.references(spark, sf_dir, IUPAC), MIXED)


RULE = {"A": "AR", "C": "CY", "R": "AGR", "N": "N"}


@register(f"{_windows('[AR][CY][AGR][N]', 4, IUPAC)} SELECT count(*) AS n FROM h")
def count_user_rule(spark, sf_dir):
    return search.count(src.references(spark, sf_dir, IUPAC), "ACRN", RULE)


@register(f"{_with()} SELECT sum(length(seq) + 1)::BIGINT AS n FROM r")
def hit_set_full(spark, sf_dir):
    return HitSet.of(src.references(spark, sf_dir)).count()


@register("SELECT 0::BIGINT AS n")
def count_exactdna_n_zero(spark, sf_dir):
    return search.count(src.references(spark, sf_dir, IUPAC), "N", "exact")


@register(f"{_with()} SELECT sum(length(seq) + 1)::BIGINT AS n FROM r")
def count_empty_pattern(spark, sf_dir):
    return search.count(src.references(spark, sf_dir), "")


@register(f"{_windows(ACAC, 4)} SELECT seq_id, 'seq_' || seq_id AS header, pos::INT AS pos FROM h")
def locate_exact(spark, sf_dir):
    return search.locate(src.references(spark, sf_dir), ACAC)


@register(f"{_windows(MIXED_REGEX, 4, IUPAC)} SELECT seq_id, 'seq_' || seq_id AS header, pos::INT AS pos FROM h")
def locate_iupac(spark, sf_dir):
    return search.locate(src.references(spark, sf_dir, IUPAC), MIXED)


@register(f"{_windows(ACAC, 4)}, o AS ({START}) SELECT (start + pos)::BIGINT AS text_pos FROM h JOIN o USING (seq_id)")
def locate_text_positions(spark, sf_dir):
    return search.positions(src.offsets(src.references(spark, sf_dir)), ACAC)


READS = "q AS (SELECT * FROM (SELECT item_id AS query_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS pattern FROM benchmark) WHERE length(pattern) > 0)"


@register(f"""{_with()}, {READS}, w AS (SELECT seq_id, seq, unnest(range(0, length(seq) - 7)) AS pos FROM r)
    SELECT query_id, seq_id, pos::INT AS pos FROM q JOIN w ON substr(seq, pos + 1, 8) = substr(pattern, 1, 8) WHERE substr(seq, pos + 1, length(pattern)) = pattern""")
def locate_batch(spark, sf_dir):
    return search.locate_many(src.references(spark, sf_dir), src.reads(spark, sf_dir))


def _masks(kmer: str, k: int) -> str:
    """Masks of k symbols, half a byte each."""
    return f"list_sum(list_transform(range(0, {k}), lambda i: (instr('{HEX_DIGITS}', substr(translate({kmer}, '{IUPAC}', '{HEX}'), (i + 1)::INT, 1)) - 1)::BIGINT << (4 * i)::INT))::BIGINT"


def _overlap(a: str, b: str, k: int) -> str:
    """Whether two packed k-mers match place by place."""
    x, ones = f"({a} & {b})", int("1" * k, 16)
    return f"((({x} | ({x} >> 1) | ({x} >> 2) | ({x} >> 3)) & {ones}) = {ones})"


@register(f"""{_with(IUPAC)}, {_reads(IUPAC)}, w AS MATERIALIZED (SELECT seq_id, pos, substr(seq, pos + 1, 12) AS kmer FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - 11)) AS pos FROM r)),
    rk AS MATERIALIZED (SELECT kmer, {_masks("kmer", 12)} AS m FROM (SELECT DISTINCT kmer FROM w)), qk AS MATERIALIZED (SELECT query_id, {_masks("pattern[1:12]", 12)} AS a, pattern FROM q WHERE length(pattern) >= 12),
    p AS MATERIALIZED (SELECT query_id, kmer, pattern FROM qk JOIN rk ON {_overlap("qk.a", "rk.m", 12)}),
    h AS MATERIALIZED (SELECT query_id, seq_id, pos, pattern, substr(seq, pos + 1, length(pattern)) AS piece FROM p JOIN w USING (kmer) JOIN r USING (seq_id) WHERE pos + length(pattern) <= length(seq)),
    x AS (SELECT query_id, seq_id, pos, unnest(string_split(translate(pattern, '{IUPAC}', '{HEX}'), '')) AS a, unnest(string_split(translate(piece, '{IUPAC}', '{HEX}'), '')) AS b FROM h)
    SELECT query_id, seq_id, pos::INT AS pos FROM x GROUP BY ALL HAVING bool_and(((instr('{HEX_DIGITS}', a) - 1) & (instr('{HEX_DIGITS}', b) - 1)) <> 0)""")
def locate_batch_iupac(spark, sf_dir):
    return search.locate_many(src.references(spark, sf_dir, IUPAC), src.reads(spark, sf_dir, IUPAC), 12, "iupac")


@register(f"""{_with()}, o AS ({START}) SELECT (start + i)::BIGINT AS text_pos, seq_id, i::INT AS pos FROM (SELECT start, seq_id, unnest(range(0, len + 1)) AS i FROM o)""")
def map_position(spark, sf_dir):
    refs = index.cut(src.offsets(src.references(spark, sf_dir)))
    return search.map_position(refs, index.text(refs.select("seq_id", "seq")).select("text_pos"))


@register(f"{_windows('ACACT', 5)} SELECT seq_id, pos::INT AS pos FROM h")
def extend_right(spark, sf_dir):
    return HitSet.of(src.references(spark, sf_dir), ACAC).extend_right("T").locate()


@register(f"{_windows('TACAC', 5)} SELECT seq_id, pos::INT AS pos FROM h")
def extend_left(spark, sf_dir):
    return HitSet.of(src.references(spark, sf_dir), ACAC).extend_left("T").locate()


@register(f"""{_windows(ACAC, 4)}, m AS (SELECT seq_id, pos AS lo, pos + 4 AS hi, CASE WHEN pos <= max(pos + 4) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM h),
    g AS (SELECT *, sum(f) OVER (PARTITION BY seq_id ORDER BY lo) AS run FROM m) SELECT seq_id, min(lo)::INT AS lo, max(hi)::INT AS hi FROM g GROUP BY seq_id, run""")
def merge_intervals(spark, sf_dir):
    hits = search.locate(src.references(spark, sf_dir), ACAC).select("seq_id", F.col("pos").alias("lo"), (F.col("pos") + 4).alias("hi"))
    return index.merge_intervals(hits, ["seq_id"])


MEMS = f"""{_with()}, {READS}, qk AS (SELECT query_id, pattern, unnest(range(0, length(pattern) - {MIN_LEN - 1})) AS i FROM q), rk AS (SELECT seq_id, seq, unnest(range(0, length(seq) - {MIN_LEN - 1})) AS p FROM r),
    s AS (SELECT query_id, seq_id, i, p - i AS diag FROM qk JOIN rk ON substr(pattern, i + 1, {MIN_LEN}) = substr(seq, p + 1, {MIN_LEN})),
    t AS (SELECT *, i - row_number() OVER (PARTITION BY query_id, seq_id, diag ORDER BY i) AS run FROM s),
    u AS (SELECT query_id, seq_id, diag, min(i) AS b, max(i) + {MIN_LEN} AS e FROM t GROUP BY query_id, seq_id, diag, run),
    v AS (SELECT query_id, b, max(e) AS e FROM u GROUP BY query_id, b), x AS (SELECT a.* FROM v a WHERE NOT EXISTS (SELECT 1 FROM v c WHERE c.query_id = a.query_id AND c.b < a.b AND c.e >= a.e)),
    y AS (SELECT x.query_id, x.b::INT AS query_start, x.e::INT AS query_end, u.seq_id, (x.b + u.diag)::INT AS pos FROM x JOIN u ON u.query_id = x.query_id AND u.b <= x.b AND u.e >= x.e)"""
SPANS = f"{MEMS} SELECT query_id, query_start, query_end, count(*) AS match_count FROM y GROUP BY ALL"
PLACES = """SELECT query_id, query_start, query_end, count(*) OVER w AS match_count, count(*) OVER w > {cap} AS truncated, seq_id, pos FROM y
    WINDOW w AS (PARTITION BY query_id, query_start, query_end) QUALIFY row_number() OVER (PARTITION BY query_id, query_start, query_end ORDER BY seq_id, pos) <= {cap}"""


@register(SPANS)
def find_mems_k12(spark, sf_dir):
    return mems.find_mems(src.references(spark, sf_dir), src.reads(spark, sf_dir), MIN_LEN)


@register(SPANS)
def find_smems_k12(spark, sf_dir):
    return mems.find_smems(src.references(spark, sf_dir), src.reads(spark, sf_dir), MIN_LEN)


@register(f"{MEMS} {PLACES.format(cap=1 << 40)}")
def find_mems_located(spark, sf_dir):
    return mems.located(src.references(spark, sf_dir), src.reads(spark, sf_dir), MIN_LEN)


@register(f"{MEMS} {PLACES.format(cap=2)}")
def find_mems_capped(spark, sf_dir):
    return mems.located(src.references(spark, sf_dir), src.reads(spark, sf_dir), MIN_LEN, max_hits=2)


@register(f"{MEMS} SELECT coalesce(sum(match_count), 0)::BIGINT AS n FROM ({SPANS.removeprefix(MEMS)})")
def mem_coverage(spark, sf_dir):
    return mems.coverage(mems.find_mems(src.references(spark, sf_dir), src.reads(spark, sf_dir), MIN_LEN))


def _ambiguous_mems(letters: str, k: int, least: int) -> str:
    """Maximal matches of `least` symbols or more between texts of these letters, from seeds of k symbols, an even number."""
    halves = f"{_masks('kmer[1:' + str(k // 2) + ']', k // 2)} AS m, {_masks('kmer[' + str(k // 2 + 1) + ':]', k // 2)} AS n"
    return f"""{_with(letters)}, {_reads(letters)}, qk AS (SELECT query_id, unnest(range(0, length(pattern) - {k - 1})) AS i, pattern FROM q), rk AS MATERIALIZED (SELECT seq_id, pos AS p, substr(seq, pos + 1, {k}) AS kmer FROM (SELECT seq_id, seq, unnest(range(0, length(seq) - {k - 1})) AS pos FROM r)),
    qw AS MATERIALIZED (SELECT query_id, i, substr(pattern, i + 1, {k}) AS kmer FROM qk), qm AS MATERIALIZED (SELECT kmer, {halves} FROM (SELECT DISTINCT kmer FROM qw)), rm AS MATERIALIZED (SELECT kmer, {halves} FROM (SELECT DISTINCT kmer FROM rk)),
    pairs AS MATERIALIZED (SELECT qm.kmer AS qkmer, rm.kmer AS rkmer FROM qm JOIN rm ON {_overlap("qm.m", "rm.m", k // 2)} AND {_overlap("qm.n", "rm.n", k // 2)}),
    s AS (SELECT query_id, seq_id, i, p - i AS diag FROM qw JOIN pairs ON qkmer = qw.kmer JOIN rk ON rk.kmer = rkmer),
    t AS (SELECT *, i - row_number() OVER (PARTITION BY query_id, seq_id, diag ORDER BY i) AS run FROM s),
    u AS MATERIALIZED (SELECT query_id, seq_id, diag, min(i) AS b, max(i) + {k} AS e FROM t GROUP BY query_id, seq_id, diag, run HAVING max(i) + {k} - min(i) >= {least}),
    v AS (SELECT query_id, b, max(e) AS e FROM u GROUP BY query_id, b), x AS (SELECT a.* FROM v a WHERE NOT EXISTS (SELECT 1 FROM v c WHERE c.query_id = a.query_id AND c.b < a.b AND c.e >= a.e))
    SELECT x.query_id, x.b::INT AS query_start, x.e::INT AS query_end, count(*) AS match_count FROM x JOIN u ON u.query_id = x.query_id AND u.b <= x.b AND u.e >= x.e GROUP BY ALL"""


@register(_ambiguous_mems("ACGTY", 8, 8))
def find_mems_iupac(spark, sf_dir):
    return mems.find_mems(src.references(spark, sf_dir, "ACGTY"), src.reads(spark, sf_dir, "ACGTY"), 8, "iupac")


@register(_ambiguous_mems(IUPAC, 20, 20))
def find_mems_all_codes(spark, sf_dir):
    return mems.find_mems(src.references(spark, sf_dir, IUPAC), src.reads(spark, sf_dir, IUPAC), 20, "iupac")


@register("SELECT item_id AS record, 'read ' || item_id AS header, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark WHERE regexp_matches(text, '[ACGTacgt]')")
def fasta_parse(spark, sf_dir):
    reads = src.reads(spark, sf_dir)
    lines = F.concat(F.lit("> read "), "query_id", F.lit("\n"), F.substring("pattern", 1, 10), F.lit("\n\n  "), F.expr("substring(pattern, 11)"), F.lit("\r\n"))
    files = reads.select(F.col("query_id").cast("string").alias("path"), lines.alias("value"))
    return src.parse_fasta(files).select(F.col("path").cast("long").alias("record"), "header", "seq")
