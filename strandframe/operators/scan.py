"""Searching every place of the sequences for a few patterns with ambiguity codes.

Symbols are masks of bases, and four of them in a row a number of 16 bits.  For each such number a row of bits says
which seeds can have it at their symbols 1 to 4, another one at 5 to 8, and so on; the seeds that match at a place are the
bits that its rows share.  What matches is then followed symbol by symbol.  Ambiguous texts match one another over long
stretches, so seeds are long, and grow with the matches found.  Neither windows nor hits of seeds are sent about: only the text in
pieces, and results.  Needs numpy and pyarrow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions.iupac import BASES, mask

from .search import PIECE, pieces

SEED = 40  # the longest seeds
GROUP, PLACES, SLICE = 1024, 4096, 1 << 22  # seeds and places that are compared at once; symbols that are held at once
FIRST, FASTER = 1 << 12, 8  # symbols of a task's first slice at least; how much larger the next ones are, and the reads together
MOST_SEEDS, MOST_SYMBOLS = 1 << 18, 1 << 20  # of the different patterns of a batch that is searched for in this way
SPARSE = 16  # once fewer than one word in so many has a bit left, only those are followed

_MASKS = np.zeros(256, "u1")
for _symbol in BASES:
    _MASKS[ord(_symbol)] = mask(_symbol)


def _masks(text: str) -> np.ndarray:
    """One mask for each code point; 0, which matches nothing, for all but the codes."""
    return _MASKS[np.frombuffer(text.encode("ascii", "replace"), "u1")]


def _strung(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(masks of all texts, with a 0 before and after each, where each one starts)."""
    parts = [np.zeros(1, "u1")]
    for text in texts:
        parts += [_masks(text), parts[0]]
    sizes = np.array([len(x) for x in parts[1::2]], "i8")
    return np.concatenate(parts), np.cumsum(sizes + 1) - sizes


class _Seeds:
    """Rows of bits for seeds, given as where they start in masks and how many symbols they have."""

    def __init__(self, masks: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.words, n = -(-len(starts) // 64), len(starts)
        values, self.tables = np.arange(16, dtype="u1"), []
        for at in range(0, int(lengths.max()), 4):
            table = np.full((1, self.words), ~np.uint64(0))
            for j in range(at, at + 4):
                fits = np.zeros((16, self.words * 64), bool)
                there = masks.take(starts + j, mode="clip")
                fits[:, :n] = (values[:, None] & there[None, :] != 0) | (j >= lengths)[None, :]
                bits = np.packbits(fits, axis=1, bitorder="little").view("<u8")
                table = (bits[:, None, :] & table[None, :, :]).reshape(-1, self.words)
            self.tables.append(table)

    def hits(self, four: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place, seed) of all that match at places below n; four: the number at each place, and at SEED more."""
        for a in range(0, n, PLACES):
            z = min(n, a + PLACES)
            rows, k = self.tables[0].take(four[a:z], axis=0), 1
            while k < len(self.tables) and np.count_nonzero(rows) * SPARSE >= rows.size:
                rows &= self.tables[k].take(four[a + 4 * k : z + 4 * k], axis=0)
                k += 1
            rows = rows.ravel()
            at = np.flatnonzero(rows)
            left = rows.take(at)
            for j in range(k, len(self.tables)):
                left &= self.tables[j][four.take(a + 4 * j + at // self.words), at % self.words]
                more = np.flatnonzero(left)
                at, left = at.take(more), left.take(more)
            while len(at):
                low = left & (~left + np.uint64(1))
                yield a + at // self.words, at % self.words * 64 + np.bitwise_count(low - np.uint64(1))
                left ^= low
                more = np.flatnonzero(left)
                at, left = at.take(more), left.take(more)


def _matched(text: np.ndarray, masks: np.ndarray, p: np.ndarray, x: np.ndarray, way: int) -> np.ndarray:
    """How many symbols in a row match from text[p] and masks[x] on, forward or backward; both have a 0 at their ends."""
    n = np.zeros(len(p), "i8")
    live = np.arange(len(p))
    while len(live):
        on = np.flatnonzero(text.take(p) & masks.take(x))
        live, p, x = live.take(on), p.take(on) + way, x.take(on) + way
        n[live] += 1
    return n


def _slices(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray]]:
    """(batch, first row, masks of some rows' last column strung together, where each row starts), of `room` symbols at first and SLICE at last."""
    for batch in batches:
        texts, at = batch.column(batch.num_columns - 1).to_pylist(), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= room):
                size, to = size + len(texts[to]), to + 1
            yield batch, at, *_strung(texts[at:to])
            at, room = to, min(SLICE, room * FASTER)


def _hits(text: np.ndarray, masks: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, seeds) of all hits of the seeds at these starts in masks, many at once."""
    padded = np.concatenate((text, np.zeros(SEED + 4, "u1"))).astype("u2")
    four = padded[:-3] | padded[1:-2] << 4 | padded[2:-1] << 8 | padded[3:] << 12
    for first in range(0, len(starts), GROUP):
        held, size = [], 0
        for p, seed in _Seeds(masks, starts[first : first + GROUP], lengths[first : first + GROUP]).hits(four, len(text)):
            held.append((p, first + seed))
            size += len(p)
            if size >= SLICE // 4:
                yield tuple(map(np.concatenate, zip(*held)))
                held, size = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held)))


def _stabbed(best: np.ndarray, begins: np.ndarray, lengths: list[int], min_len: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of seeds, one of which is in every match that ends beyond all known ones which begin no later.

    best: the end of the longest match known from each place.  Such a match holds the window up to one symbol
    beyond that end; windows are taken in order and share a seed where they can.
    """
    starts, sizes = [], []
    for b, n in zip(begins.tolist(), lengths):
        if n < min_len:
            continue
        begin = np.arange(b, b + n - min_len + 1)
        end = np.maximum(np.maximum.accumulate(best[begin]), begin + min_len - 1) + 1
        last, until = -1, -1
        for x, z in zip(begin.tolist(), end.tolist()):
            if z > b + n:
                break
            if not (last >= x and until <= z):
                size = min(z - x, SEED, max(8, (z - x) * 2 // 3 // 4 * 4))
                last, until = z - size, z
                starts.append(last)
                sizes.append(size)
    return np.array(starts, "i8"), np.array(sizes, "i8")


def laid(refs: DataFrame, texts: list[str]) -> tuple[DataFrame, int]:
    """(seq_id, _base, _piece) of refs (seq_id, seq), each piece with what a match of any of the texts can reach into; the pieces' size."""
    more = max(map(len, texts), default=0)
    size = max(PIECE, more)
    return pieces(refs, ["seq_id"], F.col("seq"), more, size).select("seq_id", "_base", "_piece"), size


def longest(cut: DataFrame, reads: list[str], min_len: int) -> list[list[tuple[int, int]]]:
    """For each of the reads that cut was laid out for (begin, end) of matches of min_len symbols or more, with all that end beyond those which begin no later."""
    masks, begins = _strung(reads)
    lengths = [len(x) for x in reads]
    out: list[list[tuple[int, int]]] = [[] for _ in reads]
    if not lengths or max(lengths) < min_len:
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(len(masks), "i8")
        for _, _, text, _ in _slices(batches, max(FIRST, len(masks) // FASTER)):
            starts, sizes = _stabbed(best, begins, lengths, min_len)
            for p, seed in _hits(text, masks, starts, sizes):
                x, size = starts.take(seed), sizes.take(seed)
                before = _matched(text, masks, p - 1, x - 1, -1)
                after = _matched(text, masks, p + size, x + size, 1)
                some = np.flatnonzero(before + size + after >= min_len)
                np.maximum.at(best, x.take(some) - before.take(some), (x + size + after).take(some))
        reach = np.maximum.accumulate(best)
        at = 1 + np.flatnonzero(best[1:] > reach[:-1])  # reads lie in a row, so no earlier one reaches into a read
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(best[at])], ["begin", "end"])

    rows = cut.select("_piece").mapInArrow(run, "begin long, end long").groupBy("begin").agg(F.max("end").alias("end")).collect()
    for begin, end in rows:
        k = int(np.searchsorted(begins, begin, "right")) - 1
        out[k].append((begin - int(begins[k]), end - int(begins[k])))
    return out


def locate(cut: DataFrame, patterns: list[str], size: int) -> DataFrame:
    """(which, seq_id, pos): all places of each pattern, looked for by its least ambiguous seed.

    None is empty, or longer than the texts that cut was laid out for, in pieces of `size` symbols.
    """
    masks, begins = _strung(patterns)
    lengths = np.array([len(x) for x in patterns], "i8")
    heavy = np.concatenate(([0], np.cumsum(np.bitwise_count(masks).astype("i8"))))
    sizes = np.minimum(lengths, SEED)
    shifts = np.array([int(np.argmin(heavy[b + s : b + n + 1] - heavy[b : b + n - s + 1])) for b, n, s in zip(begins, lengths, sizes)], "i8")
    kind = cut.schema["seq_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, text, where in _slices(batches, SLICE):
            for p, seed in _hits(text, masks, begins + shifts, sizes):
                row = np.searchsorted(where, p, "right") - 1
                at = p - shifts.take(seed) - where.take(row)
                own = np.flatnonzero((at >= 0) & (at < size))
                row, at, seed = row.take(own), at.take(own), seed.take(own)
                whole = np.flatnonzero(_matched(text, masks, where.take(row) + at, begins.take(seed), 1) == lengths.take(seed))
                row, at, seed = first + row.take(whole), at.take(whole), seed.take(whole)
                pos = batch.column(1).to_numpy().take(row) + at
                yield pa.RecordBatch.from_arrays([pa.array(seed, pa.int32()), batch.column(0).take(pa.array(row)), pa.array(pos, pa.int32())], ["which", "seq_id", "pos"])

    return cut.mapInArrow(run, f"which int, seq_id {kind}, pos int")
