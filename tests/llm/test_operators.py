import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandframe.llm import ann, bpe, chunks, components, fingerprints, html, langid, licences, packing, pii, simhash, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long"
TEXTS = ["", None, "one", "The cat sat on the mat and the dog ran.\nA second line here.", "x " * 3000, "   \n\n\t ", "Zoë ran 42 times — ça va? <|endoftext|>", "one"]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts of all kinds, a repeated row, and an extra column with a clashing name."""
    rows = [(i, t, "en", "s", len(t or ""), 7) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3]], DOCS)


def empty(docs):
    return docs.limit(0)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    root = list(range(60))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_links_equal_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)] + [0]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(8)}
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    assert len(got) == len(set(got)) and {(min(x), max(x)) for x in got} == want


def test_near_duplicates_of_odd_rows(docs):
    rows = simhash.near_duplicates(docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 9 and by_id[7]["component_id"] == 2 and by_id[0]["fingerprint"] == "0" * 16
    assert {by_id[i]["component_id"] for i in (0, 1, 5)} == {0}
    assert simhash.near_duplicates(empty(docs)).count() == 0
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == sorted({r["component_id"] for r in rows})


def test_keep_one_of_null_and_repeated_ids(spark):
    texts = [" ".join(f"{k}{w}" for w in range(60)) for k in "abcdef"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (2, texts[4]), (None, texts[4]), (3, texts[4]), (3, texts[5]), (4, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (2, texts[4]), (3, texts[5]), (4, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_language(spark, docs):
    rows = [(i, f"{'the and of with that ' if i % 2 else 'der und die nicht ein '}{i} " * 3, "en" if i % 2 else "de") for i in range(300)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(known)
    got = {r["doc_id"]: r for r in langid.identify(known, model).collect()}
    assert all(got[i]["lang_pred"] == lang and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, lang in rows)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    assert odd[0] == odd[1] == odd[5] == "und" and odd[3] in ("en", "de")
    assert langid.fit(empty(docs)) is None and langid.identify(empty(docs), None).count() == 0


def test_packing_bounds_are_best():
    rng = np.random.default_rng(5)
    from itertools import combinations

    for _ in range(20):
        top = np.sort(rng.choice(50, 7, replace=False))
        count = rng.integers(1, 9, 7)

        def padding(bounds):
            return sum(c * (min(b for b in bounds if b >= t) - t) for c, t in zip(count, top))

        best = min(padding([*c, top[-1]]) for c in combinations(top[:-1], 2))
        assert padding(packing.best_bounds(count, count * top, top, 3)) == best


def test_packing_rows(docs):
    rows = packing.pack(docs, budget=64, n_buckets=3).collect()
    assert len(rows) == 9 and all(r["padding"] >= 0 for r in rows)
    batches = {}
    for r in rows:
        batches.setdefault((r["bucket"], r["batch_id"]), []).append(r)
    assert all(len(b) == 1 or len(b) * b[0]["bucket_len"] <= 64 for b in batches.values())
    assert all(sorted(r["slot"] for r in b) == list(range(len(b))) for b in batches.values())
    assert packing.pack(empty(docs)).count() == 0


def test_bpe_equals_tiktoken(docs):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coder, rng = bpe.Codec(ranks, public_tokenizers.PATTERN), random.Random(6)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\xa0", "é", "日本", "12", "'s", "!", "🙂", "\r\n", "\x1c", "\x85", "ing"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        ids = coder.encode(text)
        assert ids == known.encode_ordinary(text) and "".join(coder.decode(ids, 3)) == text
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        ids = known.encode_ordinary(text or "")
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_token_blocks():
    rng = np.random.default_rng(7)
    for n in (1, 5, 2048, 2049, 6000):
        for ids in (rng.zipf(1.3, n).clip(1, 65536) - 1, rng.integers(0, 65536, n), rng.integers(0, 1 << 31, n), np.zeros(n, "i8")):
            data = tokens.encode_blocks(ids)
            assert (tokens.decode_blocks(data) == ids).all()
    many = np.arange(200_000)
    assert (tokens.decode_blocks(tokens.encode_blocks(many)) == many).all() and len(tokens.decode_blocks(b"")) == 0
    data = tokens.encode_blocks(rng.integers(0, 300, 6000))
    for at in (2, 9, len(data) // 2, len(data) - 40):
        bad = bytearray(data)
        bad[at] ^= 0x41
        with pytest.raises(ValueError):
            tokens.decode_blocks(bytes(bad))
    with pytest.raises(ValueError):
        tokens.decode_blocks(data[:-1])


def test_token_blocks_are_smaller_than_deflate(spark):
    documents = pd.read_parquet("/root/testdata/sf0.01/documents.parquet").sort_values("doc_id")
    encode = tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.concatenate([np.insert(x, ends, 0) for _, x, ends in encode(pa.array(documents["text"], pa.string()))])
    assert len(tokens.encode_blocks(ids)) < 0.95 * len(zlib.compress(ids.astype("<u2").tobytes()))


def test_chunks_equal_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, rng = Tokenizer.from_file(path), random.Random(8)
    parts = ["a", "The", " ", "  ", "\n", "\t", "\xa0", "é", "日本", "12", "'s", "!", ",", ".", "🙂", "\r\n", "\x1c", "\x85", "\x01", "ing", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(4000)] + [None, "\x01\x02\x03\x04\x05\x06 a b"]
    encode = tokens.encoder(path)
    encode.slice_bytes = 4000
    at = 0
    for first, ids, ends in encode(pa.array(texts)):
        for text, a, b in zip(texts[first:], [0, *ends], ends):
            assert ids[a:b].tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
            at += 1
    encode.slice_bytes = 8 << 20
    assert at == len(texts)


def test_token_blocks_are_still_the_same():
    ids = np.arange(50_000) ** 2 // 7 % 977 * (np.arange(50_000) % 5)
    data = tokens.encode_blocks(ids)
    assert zlib.crc32(data) == 0x95a63a3d and (tokens.decode_blocks(data) == ids).all()


def test_signs_after_words_are_chunks_that_recur():
    encoded = []
    encode = chunks.BatchEncoder(lambda new: [encoded.append(x) or [len(x)] for x in new])
    assert [ids.tolist() for _, ids, _ in encode(pa.array(["word$$$ other!! a.b_c", "don't$$$ other$$$", "né$$$÷$$$"]))] == [[4, 3, 6, 2, 2, 2, 2, 5, 3, 6, 3, 2, 7]]
    assert encoded == ["word", "$$$", " other", "!!", " a", ".b", "_c", "don't", "né", "$$$÷$$$"]


def test_chunks_are_cut_where_the_rules_say(monkeypatch):
    rng, parts = random.Random(2), ["a", "Z", " ", "   ", "\n", "\t", "é", "×", "÷", "ÿ", "À", "日", "!", "$", "_", "'", ".", "7", "~", "\x7f", "\x97", "<e>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)] + ["", None, ""]
    begins = lambda x, y: y in " \n" or x == "\n" or bool(re.fullmatch("[A-Za-zÀ-ÖØ-öø-ÿ][!-&(-/:-@[-`{-~]", x + y))
    for block in (1, 3, 1 << 19):
        monkeypatch.setattr(chunks, "BLOCK", block)
        encode = chunks.BatchEncoder(lambda new: [list(x.encode()) + [-1] for x in new], ["<e>"], slice_bytes=4000)
        got = [x for _, ids, ends in encode(pa.array(["x", *texts])[1:]) for x in np.split(ids, ends)[:-1]]
        assert len(got) == len(texts)
        for text, ids in zip(texts, got):
            text = text or ""
            whole = re.search(r"\s{3}|\s{2}\Z|<e>", text)
            cut = text[:1] + "".join("\0" * (not whole and begins(x, y)) + y for x, y in zip(text, text[1:]))
            assert ids.tolist() == [b for part in cut.split("\0") if part for b in [*part.encode(), -1]], repr(text)


def test_no_small_rest_is_a_slice():
    encode = chunks.BatchEncoder(lambda new: [[len(x)] for x in new], slice_bytes=100)
    slices = lambda n: [len(ends) for _, _, ends in encode(pa.array(["word"] * n, pa.string()))]
    assert (slices(25), slices(31), slices(32), slices(57), slices(0)) == ([25], [31], [25, 7], [25, 25, 7], [])
    assert [len(ends) for _, _, ends in encode(pa.array(["w" * 500, "w", None, "w" * 500, ""]))] == [1, 2, 1, 1]


def test_signs_after_words_equal_the_libraries():
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(9)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokenizer, encode, coder = Tokenizer.from_file(path), tokens.encoder(path), bpe.Codec(ranks, public_tokenizers.PATTERN)
    signs, words = list(map(chr, range(0x21, 0x7F))), ["a", "Word", " the", "é", " ñandú", "'s", "'ll", " ", "\n", "\u0301", "7"]
    texts = ["".join(rng.choice(words) + rng.choice(signs) * rng.randrange(4) for _ in range(rng.randrange(9))) for _ in range(3000)]
    texts += [f"a{x}{y}b" for x in signs for y in signs]
    got = [x for _, ids, ends in encode(pa.array(texts)) for x in np.split(ids, ends)[:-1]]
    assert [x.tolist() for x in got] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    for text in texts[:3000:3]:
        assert coder.encode(text) == known.encode_ordinary(text)


def test_token_files(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    got = sorted(tokens.round_trip(docs, path).collect(), key=lambda r: r["start"])
    at = 0
    for r in got:
        ids = np.array([*tokenizer.encode(TEXTS[r["doc_id"]] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert [r["doc_id"] for r in got] == [0, 1, 2, 3, 3, 4, 5, 6, 7]
    assert tokens.round_trip(empty(docs), path).count() == 0


def test_html():
    model = html.trained()
    page = "<html><head><title>x</title></head><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav><div class='ad'>Buy now.</div><article><h1>A &amp; B</h1><p>First  text\nhere, with words.</p><p><b>Second text, also long enough.<br><p>Third one follows here.</article><div class='comments'><p>I agree with this.</p></div><footer>&copy; us</footer></body></html>"
    assert html.main_text(page, model) == "A & B\nFirst text here, with words.\nSecond text, also long enough.\nThird one follows here."
    assert html.main_text(None, model) == html.main_text("", model) == ""
    rng = np.random.default_rng(123)
    right = 0
    for _ in range(60):
        page = html.spun_page(rng)
        want = html._is_main(page)
        nodes, x = html.features(html.parse(page.replace(" data-main", "")))
        p = model.probability(x)
        p[0] = 1
        for i in range(1, len(nodes)):
            p[i] *= p[nodes[i].parent.order]
        right += [bool(v >= 0.5) for v in p] == want
    assert right >= 48


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8)).astype("f4")
    x[50:90] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, 2.0]), (1100, [None] * 8)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    hits = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x.astype("f8") - x[q].astype("f8")) ** 2).sum(1))
        d[q] = np.inf
        want = [int(i) for i in np.lexsort((np.arange(600), d))[:10]]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r[0] for r in mine] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-9 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & set(want))
    assert hits >= 54 and {r["query_id"] for r in got} == set(range(0, 600, 100))
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")
    assert [(r["query_id"], r["rank"]) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1), (0, 2)]
    assert ann.nearest(few.limit(0)).count() == 0


def test_neighbours_over_hundreds_of_lists(spark, monkeypatch):
    """Vectors without clusters: the true neighbours lie in more lists than any small fixed number."""
    monkeypatch.setattr(ann, "LIST_SIZE", 16)
    x = np.random.default_rng(9).normal(size=(12000, 64)).astype("f4")
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(frame, every=300).collect()}
    hits = 0
    for q in range(0, 12000, 300):
        d = ((x.astype("f8") - x[q].astype("f8")) ** 2).sum(1)
        d[q] = np.inf
        hits += sum((q, int(i)) in got for i in np.argsort(d)[:10])
    assert hits >= 364


def test_fingerprints(spark, docs):
    rows = fingerprints.with_edits(docs).collect()
    assert len(rows) == 9 and {r["n_chars"] for r in rows if r["doc_id"] == 3} == {len(TEXTS[3])}
    of = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert of[2] == of[7] and of[0] == of[1] and len(set(of.values())) == 6
    order = [0, 1, 2, 3, 3, 4, 5, 6, 7]
    by = {r["doc_id"]: r for r in rows}
    for k, i in enumerate(order):
        if i != 3:
            own, after = TEXTS[i] or "", TEXTS[order[(k + 1) % 9]] or ""
            edited = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
            assert by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    assert fingerprints.with_edits(empty(docs)).count() == 0
    from pyspark.sql import functions as F

    v = lambda s: fingerprints.vector(F.lit(s))
    r = spark.range(1).select(v("a, b.\nc d") .alias("x"), v("c d\na, b.").alias("y"), fingerprints.combine(v("a, b."), v("c d")).alias("z"), fingerprints.combine(v("a, b.\nc d"), v("c d"), -1).alias("w"), v("a, b.").alias("u")).first()
    assert r["x"] == r["y"] == r["z"] and r["w"] == r["u"]


def test_likeness_without_punctuation(spark):
    words = [f"w{i}" for i in range(300)]
    han = "".join(chr(0x4E00 + 7 * i) for i in range(300))
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150], "other", *words[151:]])), (3, han), (4, han[:150] + "\u4e01" + han[151:])]
    got = {r["doc_id"]: r for r in fingerprints.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["near_next"] > 0.9 and got[3]["near_next"] > 0.9 and got[2]["near_next"] < 0.4
    assert got[2]["near_edited"] > 0.3


def test_pseudonyms(spark, docs):
    text = "call +1 (386) 555-3733, card 4041894974608795, ip 42.144.35.254, mail bosbt.42@mail8.example.com, born 1984-02-29 or 31.12.1999, 123-45-6789, DE89370400440532013000 end 12 345.6"
    frame = spark.createDataFrame([(1, text), (2, "again 4041894974608795"), (3, "4041894974608796 and 300.1.1.1"), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame).collect()}
    for part in ("555-3733", "4041894974608795", "42.144.35.254", "bosbt", "1984-02-29", "31.12.1999", "123-45-6789", "DE8937"):
        assert part not in got[1]
    assert len(got[1].split()) == len(text.split()) and got[1].endswith("end 12 345.6")
    card = got[2].split()[1]
    digits = [int(c) for c in card]
    assert card in got[1]
    assert (sum(digits[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in digits[-2::-2])) % 10 == 0
    assert got[3] == "4041894974608796 and 300.1.1.1" and got[4] is None
    kept = pii.pseudonymise(docs)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    n = F.col("id")
    mixed = pii.feistel("k", F.lit("t"), F.floor(n / 7), n % 7, F.lit(11), F.lit(7))
    got = spark.range(77).select(mixed.alias("m")).collect()
    assert len({(r["m"]["l"], r["m"]["r"]) for r in got}) == 77


def test_licences(spark, docs):
    rows = [(1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "Released under the MIT License."), (3, "Er kam mit dem Zug und mit der Tasche."), (4, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (5, None), (6, "")]
    got = {r["doc_id"]: r["families"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "apache", 2: "mit", 3: "", 4: "cc,gpl", 5: "", 6: ""}
    assert licences.scan(docs).count() == 9 and licences.scan(empty(docs)).count() == 0


def test_wrapped_licences(spark):
    mit = "MIT License\n\nCopyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"
    bsd = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n * 1. Keep this."
    gpl = "# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU General\n# Public License as published by the Free Software\n# Foundation, either version 3 of the License, or later."
    narrow = "\n".join("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files".split())
    apart = mit.replace("copy\nof", "copy\n\nof")
    one = "Released under the MIT License.\nReleased under the MIT License."
    rows = list(enumerate((mit, bsd, gpl, narrow, apart, one)))
    got = {r["doc_id"]: (r["families"], r["n_hits"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # A title is a notice of its own; the one that a blank line cuts in two is not found, but its title is.
    assert got == {0: ("mit", 2), 1: ("bsd", 1), 2: ("gpl", 1), 3: ("mit", 1), 4: ("mit", 1), 5: ("mit", 2)}


def test_ibans_with_letters_and_named_credentials(spark):
    values = ["GB29NWBK60161331926819", "GB29 NWBK 6016 1331 9268 19", "DE89 3704 0044 0532 0130 00", "ghp_abcdefghij0123456789abcdefghij012345"]
    text = f"{values[0]} and {values[1]} THEN {values[2]} with {values[3]}, api_key: Zq81kd92mx, password: correcthorse, end."
    frame = spark.createDataFrame([(1, text), (2, "GB28NWBK60161331926819 stays, token of esteem")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame).collect()}
    assert not [v for v in [*values, "Zq81kd92mx", "correcthorse"] if v in got[1]]
    assert got[1].split(" and ")[1].split(" THEN ")[0].replace(" ", "") == got[1].split(" and ")[0]
    assert len(got[1]) == len(text) and got[1].endswith(", end.") and got[2].startswith("GB28NWBK60161331926819 stays, token of esteem")
