import random

import pytest

from strandframe.operators import index, suffixes

SYMBOLS = "$ACGTNRYSWKMBDHV"
RNG = random.Random(1)
SETS = [["ACGT" * 40, "A" * 70, "".join(RNG.choice("ACGT") for _ in range(300)), "ACGT" * 40], ["A"], ["AA", "AA", "AA"], ["NRYACGTV" * 9]]


@pytest.mark.parametrize("seqs", SETS, ids=["many", "one", "equal", "codes"])
def test_records_of_the_suffix_array_equal_sorting(spark, seqs):
    table = suffixes.ordered(index.text(spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")), block=64, task=128, chunk=64)
    text = [SYMBOLS.index(x) for x in "".join(f"{s}$" for s in seqs)]
    rows = sorted(range(len(text)), key=lambda i: text[i:])
    before = [text[i - 1] for i in rows]
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(suffixes.places(table)) == list(enumerate(rows))
    assert got(suffixes.transform(table)) == list(enumerate(before))
    first = sorted(range(len(text)), key=lambda r: (before[r], r))
    assert got(suffixes.lf(table)) == [(r, before[r], first.index(r)) for r in range(len(text))]
    assert got(suffixes.samples(table)) == [(r, p) for r, p in enumerate(rows) if p % 32 == 0 or before[r] == 0]
    assert got(suffixes.checkpoints(table, 16)) == sorted((b, c, before[: 16 * b].count(c)) for b in range(-(-len(text) // 16)) for c in set(text))
    assert got(suffixes.ranks(table, [0, 1])) == sorted((c, i + 1, before[: i + 1].count(c)) for i in range(len(text)) for c in (0, 1))
    # The suffix array of k-mers is read nowhere: intervals come from counts.
    want = {}
    for r, p in enumerate(rows):
        kmer = "".join(SYMBOLS[c] for c in text[p : p + 3])
        if len(kmer) == 3 and set(kmer) <= set("ACGT"):
            lo, _ = want.get(kmer, (r, r))
            want[kmer] = (lo, r + 1)
    refs = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    assert {r["kmer"]: (r["lo"], r["hi"]) for r in index.kmer_intervals(refs, None, 3).collect()} == want
