"""Cutting texts where byte-level BPE tokenizers cut them anyway, a slice of an Arrow batch at a time.

The pre-tokenizer's pattern takes a blank only in front of a word, so a text falls apart before every
blank and around every line feed, unless white space forms a longer token there: that needs three
white-space characters in a row, or two at the end.  Such texts, and those in `whole`, are one chunk.
A run of letters also ends in front of punctuation and other signs of ASCII, which are cut off as chunks that recur.
Cuts are found among the bytes of a slice; its chunks share them and are made distinct by Arrow's kernels.  Only distinct
chunks that are not known yet are encoded, and those that occur twice in a slice are kept.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of Unicode and of the regular-expression libraries.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BEFORE, AFTER, LETTER, TAIL, LEAD, SIGN = 1, 2, 4, 8, 16, 32
#: What bytes are: cut before them (blank, line feed), cut after them (line feed), letters of ASCII, ends of letters that begin with the
#: byte C3, that byte, and signs of ASCII.  An apostrophe ends a run of letters too, but seldom stands where a cut spares work.
BYTES = bytes(
    (BEFORE if c in b" \n" else 0) | (AFTER if c == 10 else 0) | (LETTER if chr(c).isalpha() and c < 128 else 0)
    | (TAIL if 0x80 <= c < 0xC0 and c not in (0x97, 0xB7) else 0) | (LEAD if c == 0xC3 else 0) | (SIGN if 32 < c < 127 and c != 39 and not chr(c).isalnum() else 0)
    for c in range(256)
)
GROUP, PIECES, BLOCK = 16384, 32768, 1 << 19


def _cuts(text: np.ndarray) -> np.ndarray:
    """Whether a chunk begins at each of these bytes, if nothing forbids it."""
    out = np.empty(len(text), bool)
    for k in range(0, len(text), BLOCK):  # what lies between is small enough to stay near the processor
        lead = min(k, 2)
        kind = np.frombuffer(b"\0" * (2 - lead) + text[k - lead : k + BLOCK].tobytes().translate(BYTES), "u1")
        first, before, own = kind[:-2], kind[1:-1], kind[2:]
        letter = before & LETTER | (before & TAIL) >> 1 & first >> 2
        out[k : k + BLOCK] = (own & BEFORE | before & AFTER | letter & own >> 3) != 0
    return out


def _joined(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the pieces of ids that begin at start and are count long, one after another, where each one ends)."""
    ends = np.cumsum(count, dtype="i4")
    out = np.empty(ends[-1] if len(ends) else 0, ids.dtype)
    for k in range(0, len(count), PIECES):  # what lies between is small enough to stay near the processor
        n, here = count[k : k + PIECES], ends[k : k + PIECES]
        at = np.repeat(start[k : k + PIECES] - here + n, n)
        at += np.arange(here[0] - n[0], here[-1], dtype="i4")
        ids.take(at, out=out[here[0] - n[0] : here[-1]], mode="clip")
    return out, ends


class Known:
    """Ids of chunks that recurred, one after another; all are forgotten when there are more than `room` chunks."""

    def __init__(self, encode: Callable[[list[str]], Iterable[Sequence[int]]], room: int):
        self.encode, self.room = encode, room
        self._forget()

    def _forget(self) -> None:
        self.chunks = pa.array([], pa.string())
        self.ids, self.start, self.count = np.zeros(0, "i4"), np.zeros(0, "i4"), np.zeros(0, "i4")

    def rows(self, chunks: pa.Array, recur: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count): where in ids those of each of these different chunks are; new ones that recur are kept."""
        if max(len(self.chunks), len(self.ids) // 16, self.chunks.nbytes // 64) > self.room:
            self._forget()
        found = pc.fill_null(pc.index_in(chunks, self.chunks), -1).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(found < 0)
        ids, start, count, known = self.ids, self.start, self.count, len(self.chunks)
        if len(new):
            fresh = chunks.take(pa.array(new))
            parts, counts = [ids], [count]
            for at in range(0, len(fresh), GROUP):  # lists of numbers take much room, so they are made of a few chunks at a time
                got = list(self.encode(fresh[at : at + GROUP].to_numpy(zero_copy_only=False).tolist()))
                counts.append(np.fromiter(map(len, got), "i4", len(got)))
                parts.append(np.fromiter(chain.from_iterable(got), "i4", int(counts[-1].sum())))
            ids, count = np.concatenate(parts), np.concatenate(counts)
            start = np.concatenate((start, len(self.ids) + np.cumsum(count[known:], dtype="i4") - count[known:]))
            found = found.copy()
            found[new] = known + np.arange(len(new))
            kept = np.flatnonzero(recur[new])
            more, ends = _joined(ids, start.take(known + kept), count.take(known + kept))
            self.start = np.concatenate((self.start, len(self.ids) + ends - count.take(known + kept)))
            self.count = np.concatenate((self.count, count.take(known + kept)))
            self.ids = np.concatenate((self.ids, more))
            self.chunks = pa.concat_arrays([self.chunks, fresh.take(pa.array(kept))])
        return ids, start.take(found), count.take(found)


def uncollected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches, with the collector of cycles off: what is kept has none, and would be searched for them again and again."""
    gc.disable()
    try:
        yield from batches
    finally:
        gc.enable()


class BatchEncoder:
    """Encodes columns of texts by their chunks.

    encode: gives the ids of each of a list of chunks; whole: strings that the tokenizer looks for
    across chunks, so that texts with them are not cut.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable[Sequence[int]]], whole: Sequence[str] = (), room: int = 700_000, slice_bytes: int = 16 << 20):
        self.known, self.slice_bytes = Known(encode, room), slice_bytes
        self.uncut = "|".join([f"{SPACE}{{3}}", f"{SPACE}{{2}}\\z", *map(re.escape, whole)])

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, where each row's ids end) of slices of about slice_bytes; null counts as empty."""
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8"))
        at = 0
        while at < len(texts):
            done = size[at - 1] if at else 0
            most = self.slice_bytes if size[-1] - done > self.slice_bytes * 5 // 4 else size[-1] - done  # no small rest is left: each slice searches all that is known
            to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            yield (at, *self._slice(texts[at:to]))
            at = to
        pa.default_memory_pool().release_unused()

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = texts.cast(pa.string())
        _, offsets, data = texts.buffers()
        row = np.frombuffer(offsets, "i4")[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, "i4")
        text = np.frombuffer(data or b"", "u1")[row[0] : row[-1]]
        row = row - row[0]
        cut = _cuts(text)
        for k in np.flatnonzero(pc.match_substring_regex(texts, self.uncut).to_numpy(zero_copy_only=False)).tolist():
            cut[row[k] : row[k + 1]] = False
        cut[row[:-1][row[1:] > row[:-1]]] = True
        at = np.append(np.flatnonzero(cut), len(text)).astype("i4")
        ends = np.searchsorted(at[:-1], row[1:])
        chunks = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(text))
        distinct = chunks.dictionary_encode()
        order = distinct.indices.to_numpy().astype("i8")
        known, start, count = self.known.rows(distinct.dictionary, np.bincount(order, minlength=len(distinct.dictionary)) > 1)
        ids, chunk_ends = _joined(known, start.take(order), count.take(order))
        return ids, np.where(ends > 0, chunk_ends.take(ends - 1, mode="clip"), 0) if len(chunk_ends) else np.zeros(len(ends), "i4")

    def one(self, text: str) -> list[int]:
        """Ids of one text."""
        return [x for _, ids, _ in self(pa.array([text], pa.string())) for x in ids.tolist()]
