"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, convolved with filters of several widths, max-pooled over a window of fixed
length and classified by softmax.  A text's score is the mean of its windows' probabilities, weighted
by their bytes; every byte of the text lies in one window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

WINDOW, WIDTHS, EMBED, FILTERS = 192, (2, 3, 4), 8, 12
UNKNOWN = "und"


@dataclass
class ByteConvNet:
    labels: list[str]
    embed: np.ndarray  # 256, EMBED
    kernels: list[np.ndarray]  # width, EMBED, FILTERS for each width
    bias: np.ndarray  # all filters
    dense: np.ndarray  # all filters, labels
    offset: np.ndarray  # labels

    def compiled(self) -> tuple[np.ndarray, np.ndarray]:
        """Filter responses to byte pairs and single bytes, so that a convolution is a few look-ups."""
        two, three, four = self.kernels
        one = [self.embed @ k for kernel in (two, three, four) for k in kernel]
        pair = lambda a, b: (one[a][:, None, :] + one[b][None, :, :]).reshape(65536, FILTERS)
        return np.ascontiguousarray(np.concatenate([pair(0, 1), pair(2, 3), pair(5, 6), pair(7, 8)], 1), "f4"), np.ascontiguousarray(one[4], "f4")

    def windows(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray], slab: int = 48) -> np.ndarray:
        """Probabilities of windows (n, WINDOW) of uint8, zero after the text's end."""
        pairs, single = tables
        out = np.empty((len(windows), len(self.labels)), "f4")
        f = FILTERS
        for at in range(0, len(windows), slab):
            w = windows[at : at + slab]
            code = w[:, :-1].astype("i4") << 8 | w[:, 1:]
            got = pairs.take(code, axis=0)
            a = got[:, :, :f].max(1)
            b = (got[:, :-1, f : 2 * f] + single.take(w[:, 2:], axis=0)).max(1)
            c = (got[:, :-2, 2 * f : 3 * f] + got[:, 2:, 3 * f :]).max(1)
            hidden = np.maximum(np.concatenate([a, b, c], 1) + self.bias, 0)
            z = hidden @ self.dense + self.offset
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + slab] = z / z.sum(1, keepdims=True)
        return out


def cut_windows(text: bytes) -> np.ndarray:
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), "u1").reshape(n, WINDOW)


def train(samples: list[tuple[str, str]], epochs: int = 6, batch: int = 128, rate: float = 4e-3, seed: int = 7) -> ByteConvNet:
    """Fit the network to (text, label) windows; part of them is shortened so that short texts are learned."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for _, label in samples})
    rows, want = [], []
    for text, label in samples:
        raw = text.encode("utf-8", "replace")[:WINDOW]
        if not raw:
            continue
        for short in (0, 1):
            take = len(raw) if not short else int(rng.integers(3, 64))
            start = int(rng.integers(0, max(1, len(raw) - take + 1)))
            rows.append(np.frombuffer(raw[start : start + take].ljust(WINDOW, b"\0"), "u1"))
            want.append(labels.index(label))
    x, y = np.stack(rows), np.array(want)
    p = [rng.normal(0, 0.5, (256, EMBED)), *[rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS]]
    p += [np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(labels))), np.zeros(len(labels))]
    p = [a.astype("f4") for a in p]
    p[0][0] = 0
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            grads = _gradients(p, x[pick], y[pick])
            step += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                p[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return ByteConvNet(labels, p[0], p[1:4], p[4], p[5], p[6])


def _gradients(p: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    embed, kernels, (bias, dense, offset) = p[0], p[1:4], p[4:]
    n, e = len(x), embed[x]
    pooled, where = [], []
    for kernel in kernels:
        w = len(kernel)
        z = sum(e[:, j : WINDOW - w + 1 + j] @ kernel[j] for j in range(w))
        where.append(z.argmax(1))
        pooled.append(z.max(1))
    hidden = np.concatenate(pooled, 1) + bias
    act = np.maximum(hidden, 0)
    z = act @ dense + offset
    prob = np.exp(z - z.max(1, keepdims=True))
    prob /= prob.sum(1, keepdims=True)
    prob[np.arange(n), y] -= 1
    prob /= n
    g_hidden = (prob @ dense.T) * (hidden > 0)
    out = [np.zeros_like(embed)]
    row = np.arange(n)[:, None]
    for i, kernel in enumerate(kernels):
        g, gk = g_hidden[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(kernel)
        for j in range(len(kernel)):
            byte = x[row, where[i] + j]
            gk[j] = np.einsum("nfe,nf->ef", embed[byte], g)
            np.add.at(out[0], byte, g[:, :, None] * kernel[j].T[None])
        out.append(gk)
    out[0][0] = 0
    return [*out, g_hidden.sum(0), act.T @ prob, prob.sum(0)]


def held_out(doc_id: Column) -> Column:
    """Never learned from: CRC-32 of the id as text is 2 modulo 4.  False for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_label: int = 1200, max_labels: int = 256, pieces: int = 3, seed: int = 11) -> list[tuple[str, str]]:
    """Bounded sample of (text piece, label): about per_label rows of each label, pieces windows of each.

    Rows are chosen by a hash of their id against a rate from the label's count, so the sample does
    not depend on partitioning.  Held-out rows, null ids, texts and labels are left out; of more than
    max_labels labels the most frequent stay.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_labels).collect()
    if not counts:
        return []
    bound = max(40, min(per_label, 24 * per_label // len(counts)))
    rates = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, bound / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    chars = F.length("text")
    cut = lambda k: F.substring(F.col("text"), F.pmod(F.hash("doc_id", F.lit(k)), F.greatest(chars - WINDOW, F.lit(1))) + 1, F.lit(WINDOW))
    rows = (
        known.filter(draw < F.try_element_at(rates, F.col("lang")))
        .select("lang", F.xxhash64("doc_id").alias("h"), F.array_distinct(F.array(*[cut(k) for k in range(pieces)])).alias("cuts"))
        .filter(F.exists("cuts", lambda x: x.rlike(r"\p{L}"))).limit(2 * bound * len(counts)).collect()
    )
    return [(x, r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["cuts"])) for x in r["cuts"] if x]


def _judged(model: ByteConvNet, tables: tuple[np.ndarray, np.ndarray], text: str) -> np.ndarray:
    """Probabilities of the labels, from all windows of a text."""
    raw = text.encode("utf-8", "replace")
    w = cut_windows(raw)
    weight = np.full(len(w), WINDOW, "f8")
    weight[-1] = len(raw) - WINDOW * (len(w) - 1)
    return weight @ model.windows(w, tables) / weight.sum()


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: ByteConvNet | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, from its whole text.

    A null text, one without a letter, and any text when there is no model get `und` with score 0.
    Repeated rows stay; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.compiled() if model else None
        for batch in batches:
            label, score = [], []
            for text, letter in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if not letter or model is None:
                    label.append(UNKNOWN)
                    score.append(0.0)
                    continue
                p = _judged(model, tables, text.as_py())
                label.append(model.labels[int(p.argmax())])
                score.append(min(1.0, float(p.max())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text", _has_letter(F.col("text")).alias("letter")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double"
    )


def fit(docs: DataFrame, **options: int) -> ByteConvNet | None:
    """A network learned from the rows of docs that are not held out; None if there are none."""
    samples = training_sample(docs, **options)
    return train(samples) if samples else None


def accepted(docs: DataFrame, min_score: float = 0.4) -> DataFrame:
    """The rows of docs that get a language with at least min_score, with all their columns.

    Null texts, texts without a letter, and all rows when there is nothing to learn from go.  Repeated rows and
    null ids are judged like any other.
    """
    name = free_name(docs, "has_letter")
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.compiled() if model else None
        for batch in batches:
            judged = zip(batch.column("text"), batch.column(name).to_pylist(), strict=True)
            keep = [bool(letter and model and _judged(model, tables, text.as_py()).max() >= min_score) for text, letter in judged]
            yield batch.filter(pa.array(keep, pa.bool_())).drop_columns([name])

    return docs.withColumn(name, _has_letter(F.col("text"))).mapInArrow(run, docs.schema)
