import collections

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from strandframe.llm import langid, packing, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _accepted string, has_letter int, text_hash string, fp long, _row long, root int, part int"
EN, DE = "the and of with that is was for on are house river", "der und die nicht ein das mit ist von auf haus fluss"


def words(rng, pool, n):
    return " ".join(pool.split()[i] for i in rng.integers(len(pool.split()), size=n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(31)
    out = [(i, words(rng, EN if i % 2 else DE, 40), "en" if i % 2 else "de") for i in range(120)]
    out += [(200, out[3][1], "en"), (200, words(rng, EN, 60), "en"), (None, words(rng, DE, 50), "de"), (None, words(rng, EN, 50), "en"), (None, out[5][1], "en")]
    out += [(300, None, "en"), (301, "", "en"), (302, " \n\t ", None), (303, "12 34 !", "en"), (304, out[7][1] + " call 212-555-0187 or 4111111111111111", None), (7, out[7][1], "en")]
    out += [(400, " ".join(f"{w}{i}" for i, w in enumerate(words(rng, EN, 30000).split())), "en")]
    return [(*r, "s", len(r[1] or ""), "x", 1, "y", 2, 3, 4, 5) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute_components(texts):
    """Component of each text, by comparing all fingerprints."""
    prints = [brute_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def brute_fingerprint(text):
    cleaned = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        cleaned = cleaned.replace(blank, " ")
    found = [w for w in cleaned.split(" ") if w]
    if not found:
        return 0
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_each_stage(spark, docs, rows):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pseudonyms", "packed"]
    kept = corpus_pipeline.language(spark, docs, "").collect()
    model = langid.fit(docs)
    tables = model.compiled()
    fits = lambda t: bool(t) and any(c.isalpha() for c in t) and langid._judged(model, tables, t).max() >= 0.3
    assert collections.Counter(map(tuple, kept)) == collections.Counter(r for r in rows if fits(r[1]))
    assert {300, 301, 302, 303}.isdisjoint({r["doc_id"] for r in kept}) and 400 in {r["doc_id"] for r in kept}

    one = corpus_pipeline.near_duplicates(spark, docs, "")
    got = [tuple(r) for r in one.collect()]
    root = brute_components([r[1] for r in rows])
    assert one.columns == docs.columns and len(got) == len(set(root))
    of = {(r[0], r[1]): c for r, c in zip(rows, root)}
    assert sorted(of[r[0], r[1]] for r in got) == sorted(set(root))
    least = {c: min(((r[0] is None, r[0] or 0) for r, x in zip(rows, root) if x == c)) for c in set(root)}
    assert all((r[0] is None, r[0] or 0) == least[of[r[0], r[1]]] for r in got)

    said = corpus_pipeline.pseudonyms(spark, docs, "")
    assert said.columns == docs.columns
    changed = collections.Counter(map(tuple, said.collect())) - collections.Counter(rows)
    assert [r[0] for r in changed] == [304] and "212-555-0187" not in next(iter(changed))[1]

    slots = corpus_pipeline.packed(spark, docs, "").collect()
    assert sorted(r["n_tokens"] for r in slots) == sorted(len((r[1] or "").split()) for r in rows)
    sizes = sorted(len((r[1] or "").split()) for r in rows)
    count = collections.Counter(sizes)
    bounds = packing.best_bounds(np.array([count[x] for x in sorted(count)]), np.array([count[x] * x for x in sorted(count)]), np.array(sorted(count)), 32)
    exact = [b for b in bounds if b <= 1024]
    assert {r["bucket_len"] for r in slots if r["n_tokens"] <= 1024} == set(exact)
    assert all(r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0 for r in slots)


def test_run_over_a_table(spark, docs, rows, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    plain = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = simhash.keep_one(langid.accepted(plain, 0.3))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in want.collect())
    assert sum(r["n_tokens"] for r in got) == sum(len(r["text"].split()) for r in pii.pseudonymise(want).collect())


def test_empty_table(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_fingerprints_and_components_of_a_table(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    root = brute_components([r["text"] for r in rows])
    want = {(r["doc_id"], f"{brute_fingerprint(r['text']):016x}", rows[c]["doc_id"]) for r, c in zip(rows, root)}
    assert {tuple(r) for r in simhash.near_duplicates(documents).collect()} == want


def test_a_component_of_many_fingerprints(spark):
    value, prints = 0, []
    for i in range(600):
        prints.append((value - (1 << 64) if value >> 63 else value, i))
        value ^= 0b111 << (3 * i % 60)
        value ^= 1 << (i * 7 % 64)
    nodes = spark.createDataFrame(prints, "fp long, least_id long").groupBy("fp").min("least_id").withColumnRenamed("min(least_id)", "least_id")
    roots = simhash.connected_components(simhash.links(nodes))
    got = simhash._least(nodes, roots, "least_id").collect()
    assert len(got) == nodes.count() and {r["least"] for r in got} == {0}
