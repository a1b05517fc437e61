import random

import pytest

from strandframe.functions import iupac
from strandframe.operators import index, mems, search
from strandframe.plans.index import SequenceIndex
from strandframe.sources import sequences as src
from strandframe.streaming.reads import locate_stream


def refs(spark, *seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")


def match(a, b):
    return len(a) == len(b) and all(iupac.mask(x) & iupac.mask(y) for x, y in zip(a, b))


def places(seqs, pattern):
    return sorted((i, p) for i, s in enumerate(seqs) for p in range(len(s) - len(pattern) + 1) if match(pattern, s[p : p + len(pattern)]))


def reach_mems(seqs, read, least):
    end = [max([i] + [i + n for n in range(1, len(read) - i + 1) if places(seqs, read[i : i + n])]) for i in range(len(read))]
    return {(i, e, len(places(seqs, read[i:e]))) for i, e in enumerate(end) if e - i >= least and (i == 0 or end[i - 1] < e)}


@pytest.mark.parametrize("text,pattern,n", [("ACGTACGT", "ACGT", 2), ("AAAA", "AA", 3), ("AAAA", "C", 0), ("ACGTTAGCCAGTACGT", "GT", 3), ("ACGT", "", 5), ("ACG", "ACGT", 0), ("ACGT", "N", 4), ("AAAGGG", "RR", 5), ("AAAA", "S", 0), ("ACGTNACGT", "TAC", 1)])
def test_count_and_locate(spark, text, pattern, n):
    one = refs(spark, text)
    assert search.count(one, pattern).first()["n"] == n
    assert search.locate(one, pattern).count() == n


def test_exact_alphabet_ignores_n(spark):
    assert search.count(refs(spark, "ACGTNACGT"), "N", "exact").first()["n"] == 0


def test_batch_equals_brute_force_for_every_k(spark):
    rng = random.Random(1)
    seqs = ["".join(rng.choice("ACGTNR") for _ in range(60)) for _ in range(4)]
    patterns = ["".join(rng.choice("ACGTY") for _ in range(n)) for n in (1, 2, 3, 5, 6)]
    want = sorted((q, i, p) for q, x in enumerate(patterns) for i, p in places(seqs, x))
    asked = spark.createDataFrame(list(enumerate(patterns)), "query_id long, pattern string")
    for k in (2, 4):
        assert sorted(map(tuple, search.locate_many(refs(spark, *seqs), asked, k, "iupac").collect())) == want


def test_mems_equal_brute_force(spark):
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ACG") for _ in range(40)) for _ in range(3)] + ["AAC", "ACC"]
    reads = ["".join(rng.choice("ACGN"[: 3 + q % 2]) for _ in range(14)) for q in range(6)] + ["AACC"]
    asked = spark.createDataFrame(list(enumerate(reads)), "query_id long, pattern string")
    want = {(q, *m) for q, r in enumerate(reads) for m in reach_mems(seqs, r, 3)}
    for find in (mems.find_mems, mems.find_smems):
        assert set(map(tuple, find(refs(spark, *seqs), asked, 3, "iupac").collect())) == want
    assert mems.find_mems(refs(spark, *seqs), asked, 0).count() == 0


def test_capped_mem(spark):
    got = mems.located(refs(spark, "ACGT" * 4), spark.createDataFrame([(0, "ACGT")], "query_id long, pattern string"), 4, max_hits=1).collect()
    assert [(r["match_count"], r["truncated"], r["pos"]) for r in got] == [(4, True, 0)]


@pytest.mark.parametrize("seqs", [["ACGTTAGCCAGTACGT"], ["ACGT", "TTTT", "ACGT"], ["A"], ["ACACACACAC", "ACAC"]])
def test_index_tables(spark, seqs):
    symbols = index.text(refs(spark, *seqs))
    joined = "".join(s + "$" for s in seqs)
    codes = [iupac.SYMBOLS.index(c) for c in joined]
    want = sorted(range(len(codes)), key=lambda i: codes[i:])
    sa = index.cut(index.suffix_array(symbols))
    assert [r["text_pos"] for r in sa.orderBy("row").collect()] == want
    transform = index.cut(index.bwt(symbols, sa))
    last = [codes[i - 1] for i in want]
    assert [r["code"] for r in transform.orderBy("row").collect()] == last
    lf = {r["row"]: r["lf"] for r in index.lf_mapping(transform, 4).collect()}
    assert lf == {i: sum(c < x for c in codes) + last[:i].count(x) for i, x in enumerate(last)}
    asked = spark.createDataFrame([(c, i) for c in range(6) for i in range(len(codes) + 1)], "code int, i long")
    got = {(r["code"], r["i"]): r["rank"] for r in index.rank(transform, index.occ_checkpoints(transform, 4), asked, 4).collect()}
    assert got == {(c, i): last[:i].count(c) for c in range(6) for i in range(len(codes) + 1)}
    if len(seqs) == 1:
        assert [r["code"] for r in index.inverse_bwt(transform).collect()] == codes


def test_intervals_offsets_and_positions(spark):
    spans = spark.createDataFrame([(0, 1, 3), (0, 3, 5), (0, 7, 8), (1, 0, 9), (1, 2, 3)], "k int, lo int, hi int")
    assert sorted(map(tuple, index.merge_intervals(spans, ["k"]).collect())) == [(0, 1, 5), (0, 7, 8), (1, 0, 9)]
    placed = src.offsets(refs(spark, "ACGT", "TGCA"))
    asked = spark.createDataFrame([(x,) for x in (0, 3, 4, 5, 8, 10)], "text_pos long")
    assert sorted(map(tuple, search.map_position(placed, asked).collect())) == [(0, 0, 0), (3, 0, 3), (4, 0, 4), (5, 1, 0), (8, 1, 3)]


def test_fasta_validation_and_index_round_trip(spark, tmp_path):
    (tmp_path / "x.fa").write_text("acgt\nGG\n>empty\n\n> one \nACG\r\n  tt \n>two\nNNRY\n")
    got = sorted((r["header"], r["seq"]) for r in src.read_fasta(spark, str(tmp_path / "x.fa")).collect())
    assert got == [("", "GG"), ("", "acgt"), ("one", "ACGtt"), ("two", "NNRY")]
    good, bad = src.validate(refs(spark, "acgu", "ACXGT", "", None))
    assert [r["seq"] for r in good.collect()] == ["ACGT"]
    assert sorted((r["seq_id"], r["bad_offset"]) for r in bad.collect()) == [(1, 2), (2, None), (3, None)]
    built = SequenceIndex.build(refs(spark, "ACGTACGT", "TTACG"))
    built.save(str(tmp_path / "index"))
    again = SequenceIndex.load(spark, str(tmp_path / "index"))
    assert (again.text_len(), again.num_sequences(), again.count("ACG")) == (15, 2, 3)
    with pytest.raises(iupac.SequenceError):
        SequenceIndex.build(refs(spark, "A").limit(0))


def test_stream_of_reads(spark, tmp_path):
    spark.createDataFrame([(0, "ACGT"), (1, "GGG")], "query_id long, pattern string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, pattern string").parquet(str(tmp_path / "in"))
    query = locate_stream(stream, refs(spark, "ACGTACGT"), 3).writeStream.format("memory").queryName("hits").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.sql("select * from hits").collect())) == [(0, 0, 0), (0, 0, 4)]


def test_hit_set(spark):
    base = search.HitSet.of(refs(spark, "ACGTACGA"), "ACG")
    assert [r["pos"] for r in base.extend_right("T").locate().collect()] == [0]
    assert [r["pos"] for r in base.extend_left("T").locate().collect()] == [3]
    assert base.count().first()["n"] == 2


def test_suffix_array_of_copies_over_blocks(spark):
    rng = random.Random(9)
    part = "".join(rng.choice("ACGTN") for _ in range(700))
    rows = [(0, part), (1, part), (2, part[:400] + "A" + part[401:]), (3, "A" * 300), (4, "A"), (5, part[-150:])]
    symbols = index.text(src.with_headers(spark.createDataFrame(rows, "seq_id long, seq string")))
    codes = [r["code"] for r in symbols.orderBy("text_pos").collect()]
    got = [r["text_pos"] for r in index.suffix_array(symbols).orderBy("row").collect()]
    assert got == sorted(range(len(codes)), key=lambda i: codes[i:])


def test_occ_rank_asks_every_row(spark, tmp_path):
    from strandframe.queries import QUERIES

    spark.createDataFrame([(0, "ACGTACGT"), (1, "TTA")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    codes = [r["code"] for r in QUERIES["bwt"](spark, str(tmp_path)).orderBy("row").collect()]
    got = sorted((r["code"], r["i"], r["rank"]) for r in QUERIES["occ_rank"](spark, str(tmp_path)).collect())
    assert got == [(c, i, codes[:i].count(c)) for c in range(5) for i in range(1, len(codes) + 1)]


def test_find_mems_iupac_from_eight_symbols(spark, tmp_path):
    from strandframe.queries import QUERIES

    spark.createDataFrame([(0, "ACGTYACG")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "ACGTCACG")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["find_mems_iupac"](spark, str(tmp_path)).collect()
    assert [(r["query_id"], r["query_start"], r["query_end"]) for r in got] == [(5, 0, 8)]


def test_batch_equals_scalar(spark):
    seqs = ["ACGTACGTNACG", "TTACGRYACGT", "ACG"]
    patterns = ["ACGT", "acgt", "ACGU", "", "N", "RYA", "ACGTACGTNACG", "ACGTACGTNACGT", "AC-T", "A" * 9, None]
    one = src.with_headers(refs(spark, *seqs))
    asked = spark.createDataFrame(list(enumerate(patterns)), "query_id long, pattern string")
    for alphabet in ("iupac", "exact"):
        want = sorted((q, r["seq_id"], r["pos"]) for q, p in enumerate(patterns) if p is not None for r in search.locate(one, p, alphabet).collect())
        for k in (3, 8):
            assert sorted(map(tuple, search.locate_many(one, asked, k, alphabet).collect())) == want
    assert search.locate_many(one, asked.limit(0)).count() == 0


def test_a_match_rule_of_the_user(spark):
    rule = iupac.rule(spark.createDataFrame([("A", "A"), ("C", "C"), ("N", "N"), ("R", "A"), ("R", "G"), ("G", "G")], "q_sym string, r_sym string"))
    one = src.with_headers(refs(spark, "ACGNTR"))
    assert search.count(one, "N", rule).first()["n"] == 1 and search.count(one, "T", rule).first()["n"] == 0
    assert [r["pos"] for r in search.locate(one, "RC", rule).collect()] == [0]
    asked = spark.createDataFrame([(0, "RC"), (1, "GN"), (2, "T")], "query_id long, pattern string")
    assert sorted(map(tuple, search.locate_many(one, asked, 2, rule).collect())) == [(0, 0, 0), (1, 0, 2)]


def test_long_sequences_over_pieces(spark):
    rng = random.Random(21)
    text = "".join(rng.choice("ACGT") for _ in range(300_000))
    one = src.with_headers(refs(spark, text, text[5000:5100]))
    for pattern in (text[2040:2060], text[4090:4100], text[100_000:103_000], text[-30:]):
        want, at = [], text.find(pattern)
        while at >= 0:
            want.append(at)
            at = text.find(pattern, at + 1)
        assert sorted(r["pos"] for r in search.locate(one, pattern, "exact").filter("seq_id = 0").collect()) == want
    reads = spark.createDataFrame([(0, text[4000:4200]), (1, text[5050:5100] + "A" * 40)], "query_id long, pattern string")
    got = {(r["query_id"], r["query_start"]): (r["query_end"], r["match_count"]) for r in mems.find_mems(one, reads, 45).collect()}
    assert got[0, 0] == (200, 1) and got[1, 0][0] >= 50 and got[1, 0][1] >= 1
    assert {(r["seq_id"], r["pos"]) for r in search.locate_many(one, reads, 16).collect()} == {(0, 4000)}
    assert search.kmers(one, ["seq_id"], "seq", 40, "p").count() == 300_000 - 39 + 61


def test_runs_of_ambiguity_codes(spark):
    rng = random.Random(22)
    text = "".join(rng.choice("ACGT") for _ in range(200)) + "N" * 1000 + "ACGTACGT"
    reads = ["N" * 1000, text[150:260], "".join(rng.choice("ACGTRYSWKMBDHVN") for _ in range(30))]
    asked = spark.createDataFrame(list(enumerate(reads)), "query_id long, pattern string")
    one = refs(spark, text)
    got = {}
    for r in mems.find_mems(one, asked, 12, "iupac").collect():
        got.setdefault(r["query_id"], set()).add((r["query_start"], r["query_end"], r["match_count"]))
    assert got[0] == {(0, 1000, len(text) - 999)}
    short = {q: reach_mems([text], r, 12) for q, r in enumerate(reads) if q == 2}
    assert got[2] == {m[:3] for m in short[2]}
    assert any(b == 0 and e == 110 for b, e, _ in got[1])


def test_index_lookups(spark):
    seqs = ["ACGTTAGCCAGTACGTACG", "TTACGNA", "ACG"]
    built = SequenceIndex.build(refs(spark, *seqs), k=3, sa_rate=4)
    joined = "".join(s + "$" for s in seqs)
    codes = [iupac.SYMBOLS.index(c) for c in joined]
    sa = sorted(range(len(codes)), key=lambda i: codes[i:])
    assert {r["row"]: r["text_pos"] for r in built.resolve(spark.range(len(sa)).withColumnRenamed("id", "row")).collect()} == dict(enumerate(sa))
    asked = spark.createDataFrame([("ACG",), ("AAA",), ("CGN",)], "kmer string")
    rows = [i for i, p in enumerate(sa) if joined[p : p + 3] == "ACG"]
    assert {r["kmer"]: (r["lo"], r["hi"]) for r in built.lookup(asked).collect()} == {"ACG": (rows[0], rows[-1] + 1), "AAA": (0, 0), "CGN": (None, None)}
    last = [codes[i - 1] for i in sa]
    spans = [(c, lo, hi) for c in (1, 3, 5, 9) for lo, hi in ((0, 5), (3, 3), (2, len(sa)))]
    frame = spark.createDataFrame(spans, "code int, lo long, hi long")
    assert {tuple(r) for r in index.smaller_in(built.bwt(), frame, 4).collect()} == {(c, lo, hi, sum(x < c for x in last[lo:hi])) for c, lo, hi in spans}
    pairs = index.rank_pairs(built.bwt(), index.occ_checkpoints(built.bwt(), 4), frame, 4).collect()
    assert {tuple(r) for r in pairs} == {(c, lo, hi, last[:lo].count(c), last[:hi].count(c)) for c, lo, hi in spans}
    assert sorted(map(tuple, built.boundaries().collect())) == [(0, 0, 19), (1, 20, 27), (2, 28, 31)]
    assert built.reversed().count("GCA") == built.count("ACG")


def test_saved_tables_are_read_back(spark, tmp_path):
    built = SequenceIndex.build(refs(spark, "ACGTACGT", "TTACG"), k=2, sa_rate=2)
    asked = spark.range(15).withColumnRenamed("id", "row")
    want = sorted(map(tuple, built.resolve(asked).collect()))
    built.kmers()
    built.save(str(tmp_path / "index"))
    again = SequenceIndex.load(spark, str(tmp_path / "index"))
    assert set(again.tables) == {"text", "suffix_array", "bwt", "lf", "samples", "kmers"} and (again.k, again.sa_rate) == (2, 2)
    assert sorted(map(tuple, again.resolve(asked).collect())) == want
    spans = mems.find_mems(built.refs, spark.createDataFrame([(0, "ACG")], "query_id long, pattern string"), 3)
    assert mems.coverage(spans).first()["n"] == 3 and mems.coverage(spans.limit(0)).first()["n"] == 0


def test_fasta_by_lines_of_several_files(spark, tmp_path):
    rng = random.Random(23)
    for f in range(2):
        lines = [f">s{f} chromosome"] + ["".join(rng.choice("acgtn") for _ in range(60)) for _ in range(2000)] + ["", f">e{f}", f">t{f}", "ACGT", "TT"]
        (tmp_path / f"{f}.fa").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        records = src.read_fasta(spark, str(tmp_path)).collect()
        built = SequenceIndex.from_fasta(spark, str(tmp_path), alphabet="exact")
        headers = [r["header"] for r in built.refs.orderBy("seq_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = {r["header"]: r["seq"] for r in src.parse_fasta(spark.read.text(str(tmp_path), wholetext=True).selectExpr("_metadata.file_path as path", "value")).collect()}
    assert {r["header"]: r["seq"] for r in records} == whole and set(whole) == {"s0 chromosome", "t0", "s1 chromosome", "t1"} and whole["t1"] == "ACGTTT"
    assert headers == ["s0 chromosome", "t0", "s1 chromosome", "t1"]
    assert built.count("ACGTTT") >= 2


def test_checkpoints_need_a_shared_folder():
    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError):
        index.cut(Frame())
