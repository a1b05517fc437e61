import random

from pyspark.sql import functions as F

from strandframe.operators import index, suffixes
from strandframe.queries import QUERIES


def test_rows_are_resolved_without_a_join_to_the_samples_at_the_end(spark):
    text = "ACGTTGCAACGGTTACGATC" * 8
    symbols = index.cut(index.text(spark.createDataFrame([(1, text), (2, "GATTACA"), (3, "C")], "seq_id long, seq string")))
    table = index.ordered(symbols)
    rows, samples, lf = index.transform_of(table).select("row"), index.sampled_of(table), index.cut(index.lf_of(table))
    found = index.resolve(rows, samples, lf)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, index.suffix_array(symbols).collect()))


def test_walks_from_the_samples_reach_every_row(spark):
    rng = random.Random(4)
    seqs = ["ACGT" * 40, "A" * 70, "".join(rng.choice("ACGT") for _ in range(300)), "ACGT" * 40, "C", "NRYACGTV" * 9]
    table = suffixes.ordered(index.text(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")), block=64, task=128, chunk=64)
    want = sorted(map(tuple, suffixes.places(table).collect()))
    assert len(want) == sum(len(s) + 1 for s in seqs)
    for rate, per in ((1, 100), (5, 100), (12, 1 << 22)):
        assert sorted(map(tuple, suffixes.resolved(table, rate, per).collect())) == want


def test_the_query_sends_no_rows_through_joins(spark):
    folder = "/root/testdata/sf0.001"
    found = QUERIES["resolve_sa"](spark, folder)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.exceptAll(QUERIES["suffix_array"](spark, folder)).isEmpty()
    assert found.agg(F.count("*"), F.countDistinct("row")).first()[:] == (size := QUERIES["text_statistics"](spark, folder).first()["text_len"], size)
