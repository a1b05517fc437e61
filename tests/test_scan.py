import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions.iupac import SYMBOLS, mask
from strandframe.operators import mems, search


def _meet(a, b):
    return all(mask(x) & mask(y) for x, y in zip(a, b, strict=True))


def _random(n, letters, seed):
    return "".join(random.Random(seed).choices(letters, k=n))


@pytest.fixture(scope="module")
def tables(spark):
    seqs = [(1, _random(5000, "ACGTACGTACGTRYN", 1)), (2, "AC?GT" + _random(300, SYMBOLS[1:], 2)), (3, "N"), (4, None)]
    reads = [("a", seqs[0][1][2030:2080]), ("b", _random(40, SYMBOLS[1:], 3)), ("c", "ACGTACGTRYNACG"), ("d", "acgu"), ("e", ""), ("f", None), ("g", seqs[0][1][4000:4060] + "Z" + seqs[0][1][10:40])]
    return spark.createDataFrame(seqs, "seq_id long, seq string"), spark.createDataFrame(reads, "query_id string, pattern string"), dict(seqs[:3]), [(q, p.upper().replace("U", "T")) for q, p in reads if p]


def test_few_ambiguous_patterns_are_searched_for_without_comparing_windows(tables):
    refs, reads, seqs, asked = tables
    found = search.locate_many(refs, reads, 12, "iupac")
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "rlike" not in plan.lower()
    want = [(q, s, i) for q, p in asked for s, seq in seqs.items() for i in range(len(seq) - len(p) + 1) if _meet(p, seq[i : i + len(p)])]
    want += [("e", s, i) for s, seq in seqs.items() for i in range(len(seq) + 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


@pytest.mark.parametrize("least", [2, 8, 14, 20])
def test_ambiguous_matches_of_a_few_reads_equal_those_by_joined_seeds(tables, least, monkeypatch):
    refs, reads, seqs, asked = tables
    by_scan = sorted(map(tuple, mems.located(refs, reads, least, "iupac").collect()))
    assert by_scan and {r[0] for r in by_scan} >= {"a", "g"}
    if least == 2:
        refs, reads = refs.withColumn("seq", F.substring("seq", 1, 200)), reads.filter("query_id = 'c'")
        by_scan = sorted(map(tuple, mems.located(refs, reads, least, "iupac").collect()))
    monkeypatch.setattr(mems, "scanned", lambda *_: None)
    assert sorted(map(tuple, mems.located(refs, reads, least, "iupac").collect())) == by_scan


def test_copies_of_a_read_are_looked_for_once(spark, monkeypatch):
    from strandframe.operators import scan

    monkeypatch.setattr(scan, "MOST_SYMBOLS", 64)
    monkeypatch.setattr(mems, "runs", None)
    monkeypatch.setattr(search, "seed_hits", None)
    refs = spark.createDataFrame([(0, "ACGTYACGTTAGG"), (1, "TTACGTCACGTT")], "seq_id long, seq string")
    reads = spark.createDataFrame([(i, "ACGTCACGTT"[i % 2 :]) for i in range(40)] + [(40, None), (41, "")], "query_id long, pattern string")
    assert sorted(map(tuple, mems.find_mems(refs, reads, 8, "iupac").collect())) == [(i, 0, 10 - i % 2, 2) for i in range(40)]
    places = [(i, 0, 10 - i % 2, 2, False, *p) for i in range(40) for p in ((0, i % 2), (1, 2 + i % 2))]
    assert sorted(map(tuple, mems.located(refs, reads, 8, "iupac").collect())) == places
    asked = reads.filter("pattern <> ''")
    assert sorted(map(tuple, search.locate_many(refs, asked, 8, "iupac").collect())) == [(x[0], *x[-2:]) for x in places]


def test_many_different_reads_are_looked_for_without_joined_seeds(spark, monkeypatch):
    refs = spark.createDataFrame([(i, _random(1500, "ACGTACGTACGTY", 50 + i)) for i in range(2)], "seq_id long, seq string")
    reads = spark.createDataFrame([(i, _random(150, "ACGTACGTACGTY", 100 + i)) for i in range(300)], "query_id long, pattern string").cache()
    with monkeypatch.context() as joined:
        joined.setattr(mems, "scanned", lambda *_: None)
        want = sorted(map(tuple, mems.find_mems(refs, reads, 8, "iupac").collect()))
    monkeypatch.setattr(mems, "runs", None)
    got = sorted(map(tuple, mems.find_mems(refs, reads, 8, "iupac").collect()))
    assert got and got == want
