"""Licence scan: a trained paragraph classifier over sparse word n-grams, confirmed by templates.

A logistic regression over words and word pairs is trained in numpy on notices spun from templates and on
plain prose; its temperature is set on whole templates that a first fit never saw.  The scan itself is
DataFrame expressions.  A template fits a paragraph that has enough of its words, with a name if it has any, else
one at least that no other family's templates have, and, for a title, few others.  So a paragraph that fits any has
an anchor: each template gives its names, or else its longest words, more than may be missing.
Documents without an anchor are done at once; in the others, lines with one, and runs of lines that hold a
template's words together, are cut into n-grams, joined with the weights and summed.  A family is predicted where
its calibrated probability passes `threshold`, else the paragraph is unknown; a prediction is confirmed where
a template of the family fits.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Short notices of each family, as their authors word them.
TEMPLATES = {
    "apache": ["licensed under the apache license version 2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www.apache.org licenses", "spdx-license-identifier apache-2.0", "apache license version 2.0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "released under the bsd license", "spdx-license-identifier bsd-3-clause", "licensed under the bsd 3-clause license", "bsd 2-clause license"],
    "cc": ["licensed under cc by 4.0", "licensed under cc by-nc 4.0", "licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "licensed under cc by-nc-nd 4.0", "released under cc0 1.0 universal public domain dedication"],
    "eclipse": ["licensed under the eclipse public license 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", "spdx-license-identifier epl-2.0", "eclipse public license version 2.0"],
    "gpl": ["this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "spdx-license-identifier gpl-3.0-or-later", "licensed under the gnu lesser general public license", "licensed under the gnu affero general public license version 3", "gnu general public license version 2 june 1991", "gnu general public license"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "released under the isc license", "spdx-license-identifier isc", "isc license"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "licensed under the mit license", "spdx-license-identifier mit", "mit license"],
    "mozilla": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0", "spdx-license-identifier mpl-2.0", "mozilla public license version 2.0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released under the unlicense", "spdx-license-identifier unlicense"],
}
FAMILIES = sorted(TEMPLATES)
#: Prose that names licences, versions or permission without being a notice.
PROSE = [
    "the driving license was issued by the state and is valid for ten years", "he was released from prison under the terms of the agreement", "the general public was free to use the park",
    "version 3 of the report is licensed to nobody", "a work of art under the bridge", "the software was permitted to run with the following conditions", "the apache tribe lived in the mountains of the south",
    "students at mit work on many things", "the gnu is an animal of the plains", "creative people share common ideas", "the mozilla project made a browser", "this and that and the other with the of to in is it for by on",
    "er kam mit dem zug und mit der tasche", "mit einem hund im park mit freunden", "the program of the society is free and open to any person", "the files were under the table in the office",
    "permission to land was granted to the pilot", "she obtained a copy of the document", "under the tree the version of events was public", "commons are shared by the public of the village",
]
WORD = r"[^a-z0-9.-]+"
REACH = 2 * max(len(x.split()) for t in TEMPLATES.values() for x in t)
#: Templates that are titles; they fit only lines of at most twice their words.
TITLES = {
    "apache license version 2.0", "bsd 2-clause license", "eclipse public license version 2.0", "gnu general public license version 2 june 1991", "gnu general public license",
    "isc license", "mit license", "mozilla public license version 2.0",
}

#: Words that name a licence.
NAMES = set("apache apache-2.0 www.apache.org bsd bsd-3-clause cc cc0 creative eclipse epl-2.0 gnu gpl-3.0-or-later isc mit mozilla mpl-2.0 unlicense".split())


def _words(text: str) -> list[str]:
    return [w.strip(".-") for w in re.split(WORD, text.lower()) if w.strip(".-")]


def _grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _own(family: str, words: set[str]) -> set[str]:
    """The names among these words, or else those words that no other family's templates have."""
    return words & NAMES or words - {w for f, t in TEMPLATES.items() if f != family for x in t for w in _words(x)}


def _rows(notices: dict[str, list[str]], rng: np.random.Generator) -> list[tuple[set[str], int]]:
    """Spun (n-grams, class) of notices, and of prose as the unknown class."""
    rows: list[tuple[set[str], int]] = []
    prose = [_words(p) for p in PROSE]
    for family, templates in notices.items():
        for words in map(_words, templates):
            for spin in range(24):
                kept = [w for w in words if spin == 0 or rng.random() > 0.06]
                noise = list(prose[rng.integers(len(prose))]) if spin % 3 == 0 else []
                rows.append((set(_grams(noise[: len(noise) // 2] + kept + noise[len(noise) // 2 :])), FAMILIES.index(family)))
    pool, said = [w for p in prose for w in p], [w for t in notices.values() for x in t for w in _words(x)]
    for spin in range(800):
        words = [pool[i] for i in rng.integers(len(pool), size=rng.integers(3, 40))] if spin % 2 else list(prose[spin // 2 % len(prose)])
        if spin % 4 == 3:  # single words of notices, out of order
            words += [said[i] for i in rng.integers(len(said), size=3)]
        rows.append((set(_grams(words)), len(FAMILIES)))
    return rows


def _fitted(rows: list[tuple[set[str], int]], epochs: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(row of each n-gram, weights, bias) of the logistic regression, with few weights other than 0."""
    index = {g: i for i, g in enumerate(sorted(set().union(*[g for g, _ in rows])))}
    x, y = _matrix(rows, index), np.eye(len(FAMILIES) + 1, dtype="f4")[[c for _, c in rows]]
    w, b = np.zeros((len(index), y.shape[1]), "f4"), np.zeros(y.shape[1], "f4")
    b[-1] = 3.0  # a paragraph without any known n-gram is unknown
    for _ in range(epochs):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 4.0 * (x.T @ (p - y) / len(rows) + 1e-4 * w)
        w = np.sign(w) * np.maximum(np.abs(w) - 4.0 * 2e-5, 0)
    return index, w, b


def _matrix(rows: list[tuple[set[str], int]], index: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(rows), len(index)), "f4")
    for i, (grams, _) in enumerate(rows):
        x[i, [index[g] for g in grams if g in index]] = 1
    return x


@lru_cache(maxsize=1)
def trained(seed: int = 5, epochs: int = 300) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """(weights by n-gram, bias, temperature); classes are FAMILIES and last the unknown one.

    The temperature is the best on spun rows of each family's second template, for weights fitted without these.
    """
    rng = np.random.default_rng(seed)
    seen, unseen = ({f: [x for i, x in enumerate(t) if (i == 1) == held] for f, t in TEMPLATES.items()} for held in (False, True))
    index, w, b = _fitted(_rows(seen, rng), epochs)
    held = _rows(unseen, rng)
    z, y = _matrix(held, index) @ w + b, np.array([c for _, c in held])

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean())

    temperature = min(np.linspace(0.5, 2.0, 16), key=loss)
    index, w, b = _fitted(_rows(TEMPLATES, rng), epochs)
    return {g: w[i] for g, i in index.items() if np.abs(w[i]).max() > 1e-6}, b, float(temperature)


def anchors(confirm: float) -> list[str]:
    """Words of which every paragraph that fits a template has one."""
    weights = trained()[0]
    found: set[str] = set()
    for templates in TEMPLATES.values():
        for words in (set(_words(t)) & weights.keys() for t in templates):
            most = sorted(words, key=lambda w: (-len(w), w))[: int(len(words) * (1 - confirm) + 1e-9) + 1]
            found |= words & NAMES or set(most)
    return sorted(found)


def _wrapped(lines: DataFrame, confirm: float) -> DataFrame:
    """(_row, at, last, words): runs of two or more lines without a blank one that hold `confirm` of some template's words.

    Between the first and the last line of a run stand fewer than REACH words, so that a template fits however
    narrowly it is wrapped.  lines: (_row, lines), the words of each line of a document.
    """
    vocabulary = F.array(*map(F.lit, sorted({w for t in TEMPLATES.values() for x in t for w in _words(x)})))
    templates = F.array(*[F.array(*map(F.lit, sorted(set(_words(x))))) for t in TEMPLATES.values() for x in t])

    def holds(known: Column) -> Column:
        each = lambda k: F.exists(templates, lambda t: F.size(F.array_intersect(t, k)) >= F.size(t) * confirm)
        return F.element_at(F.transform(F.array(known), each), 1)  # known is computed once

    some = lines.filter(F.size("lines") > 1).withColumn("known", F.array_intersect(F.flatten("lines"), vocabulary)).filter(holds(F.col("known")))
    starts = some.select("_row", F.inline(F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.struct((i - 1).alias("at"), F.slice("lines", i, REACH + 1).alias("near")))))
    starts = starts.filter((F.size("near") > 1) & (F.size(F.element_at("near", 1)) > 0))
    starts = starts.filter(holds(F.array_intersect(F.flatten("near"), vocabulary)))
    runs = starts.select("_row", "at", "near", F.explode(F.sequence(F.lit(2), F.size("near"))).alias("n"))
    between = F.aggregate(F.slice("near", F.lit(2), F.col("n") - 2), F.lit(0), lambda t, x: t + F.size(x))
    runs = runs.withColumn("run", F.slice("near", F.lit(1), F.col("n"))).filter(F.forall("run", lambda x: F.size(x) > 0) & (between < REACH))
    runs = runs.select("_row", "at", (F.col("at") + F.col("n") - 1).alias("last"), F.flatten("run").alias("words"))
    return runs.filter(holds(F.array_intersect("words", vocabulary)))


def scan(docs: DataFrame, threshold: float = 0.6, confirm: float = 0.75) -> DataFrame:
    """One row for each document: doc_id, n_paragraphs, families (sorted), n_hits, n_unconfirmed, score.

    A line, or a run of lines without a blank one, counts for a family predicted with probability `threshold` or more
    if some template of the family fits it: at least `confirm` of its known words are there, a name or else a word
    of the family's own among them, and in a title's case at most twice as many words as the title has.  n_hits: the most of these that do not overlap, for
    each family.  n_unconfirmed: lines with an anchor that are predicted so but not confirmed, alone or within
    a run of their family.  score: the largest probability that counts, 0 for none.  n_paragraphs counts lines.
    Null and empty texts have none; repeated rows stay.  Rows are numbered in a checkpoint, so that a lost executor
    numbers none anew; only texts with an anchor are written there.
    The table of weights has as many rows as the templates and prose have n-grams, whatever the corpus.
    """
    spark = docs.sparkSession
    weights, bias, temperature = trained()
    names = [*FAMILIES, "unknown"]
    table = spark.createDataFrame([(g, *map(float, w)) for g, w in sorted(weights.items())], "gram string, " + ", ".join(f"w_{n} double" for n in names))
    named = f"(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in anchors(confirm))})(?![a-z0-9])"
    feeds = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n")))).cast("int")
    rows = cut(docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.length("text") > 0, feeds + 1).otherwise(0).alias("n_paragraphs"), F.when(F.col("text").rlike(f"(?i){named}"), F.col("text")).alias("text"),
    ))
    some = rows.filter(F.col("text").isNotNull())
    cutter = rf"^[.-]+|[.-]+(?=[^a-z0-9.-]|$)|{WORD}[.-]*"
    cleaned = lambda line: F.filter(F.split(line, cutter), lambda w: w != "")
    paragraphs = some.select("_row", F.posexplode(F.split(F.lower("text"), "\n")).alias("at", "line")).filter(F.col("line").rlike(named))
    alone = paragraphs.select("_row", "at", F.col("at").alias("last"), cleaned(F.col("line")).alias("words"))
    lines = some.filter(F.col("text").contains("\n")).select("_row", F.transform(F.split(F.lower("text"), "\n"), cleaned).alias("lines"))
    words = alone.unionByName(_wrapped(lines, confirm)).withColumn("n", F.size("words"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    grams = F.array_distinct(F.concat("words", F.when(F.size("words") > 1, pairs).otherwise(F.array().cast("array<string>"))))
    summed = (
        words.select("_row", "at", "last", "n", F.explode(grams).alias("gram")).join(F.broadcast(table), "gram")
        .groupBy("_row", "at", "last", "n").agg(*[F.sum(f"w_{n}").alias(f"w_{n}") for n in names], F.collect_set(F.when(~F.col("gram").contains(" "), F.col("gram"))).alias("said"))
    )
    logits = F.array(*[F.struct(((F.col(f"w_{n}") + float(b)) / temperature).alias("z"), F.lit(n).alias("family")) for n, b in zip(names, bias)])
    top = F.col("best.z")
    odds = F.aggregate(F.col("logits"), F.lit(0.0), lambda t, x: t + F.exp(x["z"] - top))
    summed = summed.withColumn("logits", logits).withColumn("best", F.array_max("logits")).withColumn("p", F.lit(1.0) / odds)
    literal = lambda words: F.array(*map(F.lit, sorted(words)))

    def fit(family: str, template: str) -> Column:
        words = set(_words(template)) & weights.keys()
        own, fine = _own(family, words), F.size(F.array_intersect("said", literal(words))) >= len(words) * confirm
        fine = fine & F.arrays_overlap("said", literal(own)) if own else fine
        return fine & (F.col("n") <= 2 * len(_words(template))) if template in TITLES else fine

    fits = F.lit(False)
    for family, templates in TEMPLATES.items():
        fits = F.when(F.col("best.family") == family, reduce(Column.__or__, [fit(family, t) for t in templates])).otherwise(fits)
    likely = summed.filter((F.col("best.family") != "unknown") & (F.col("p") >= threshold))
    hits = likely.select("_row", F.col("best.family").alias("family"), "at", "last", "p", fits.alias("sure")).filter(F.col("sure") | (F.col("at") == F.col("last")))
    sure = F.col("sure")
    # Runs by their last line, the shorter first: taking each that starts after the one taken before gives the most.
    by_family = hits.groupBy("_row", "family").agg(
        F.array_sort(F.collect_list(F.when(sure, F.struct("last", (-F.col("at")).alias("back"))))).alias("found"),
        F.collect_list(F.when(~sure, F.col("at"))).alias("open"), F.max(F.when(sure, F.col("p"))).alias("score"),
    )
    taken = F.aggregate(
        "found", F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda t, x: F.when(-x["back"] > t["end"], F.struct(x["last"].alias("end"), (t["n"] + 1).alias("n"))).otherwise(t),
    )
    left = F.size(F.filter("open", lambda i: ~F.exists("found", lambda x: (-x["back"] <= i) & (i <= x["last"]))))
    by_doc = by_family.withColumn("n_hits", taken["n"]).withColumn("n_unconfirmed", left.cast("long")).groupBy("_row").agg(
        F.array_sort(F.collect_set(F.when(F.col("n_hits") > 0, F.col("family")))).alias("families"),
        F.sum("n_hits").alias("n_hits"), F.sum("n_unconfirmed").alias("n_unconfirmed"), F.max("score").alias("score"),
    )
    none = rows.filter(F.col("text").isNull()).select("doc_id", "n_paragraphs", F.lit("").alias("families"), *[F.lit(0).cast("long").alias(n) for n in ("n_hits", "n_unconfirmed")], F.lit(0.0).alias("score"))
    return none.unionByName(some.drop("text").join(by_doc, "_row", "left").select(
        "doc_id", "n_paragraphs", F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
        F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"), F.coalesce("score", F.lit(0.0)).alias("score"),
    ))
