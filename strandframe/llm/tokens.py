"""Token ids as files of arithmetic-coded blocks.

A file row holds the ids of consecutive documents, cut into blocks of equal length.  Each block starts from
an empty model, has its own CRC-32 and is coded on its own, so all blocks of a row are coded in lockstep,
one lane of the numpy arrays each.  The ids of a row are numbered by falling frequency; the list of them
stands in front of its blocks.  An id is coded as a hit of the order-2 prediction, of the order-1
prediction, or else by the adaptive order-0 distribution of the bit lengths of its number and the bits below.
The three are mixed by weights that are learned for each state of confidence in the two predictions; all
arithmetic is in integers, so any machine decodes what another one wrote.
"""

from __future__ import annotations

import codecs
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .chunks import BatchEncoder, uncollected
from .common import ensure_checkpoint_dir

LANES, LEAST_BLOCK, MOST_BLOCK = 4096, 1024, 65536
ROW_IDS = 1 << 23  # a file row is closed when it holds so many
TWO, ONE = 1024, 512  # places of the order-2 and order-1 predictions of a block
CLASSES, SCALE, SHARE_EVERY = 17, 10, 128
LAST = (1 << 14) - 1  # numbers from here on are predicted as this one
MOST_NAMES = (1 << CLASSES) - 2  # different ids that one list can number
HEAD, BLOCK_MARK, NAMES_MARK = struct.Struct("<4sIII"), b"TID2", b"TIDV"
SPAN, LEAST, LOW = (1 << 48) - 1, 1 << 32, (1 << 32) - 1
ALL, MOST, RATE = 65536, 57344, 5  # both hits together get MOST of ALL at most, so that no class is left without a share
KEPT = ((1 << 16 - RATE) - 1) * 65537  # bits that a shift by RATE leaves to each half of a pair of weights


class Model:
    """Adaptive odds of the next id of each lane.

    An entry of the order-2 and order-1 tables is the id last seen there, LAST at most, times 4, and how often it was
    confirmed since (0 to 3).  Both numbers together choose the weights with which the two predictions and the order-0
    distribution are mixed; the weights learn from every id.
    """

    def __init__(self, lanes: int, n_names: int):
        self.classes, self.lanes, self.row = n_names.bit_length(), lanes, np.arange(lanes)
        # Places lie lane by lane: what is often met shares its memory with the other lanes' and so stays near the processor.
        self.two, self.one = np.full(lanes * TWO, LAST << 2, "u2"), np.full(lanes * ONE, LAST << 2, "u2")
        self.weights = np.full(lanes * 16, MOST // 4 << 16 | MOST // 8, "u4")  # of both predictions, below 1 << 16 each
        self.last, self.mark = np.zeros(lanes, "i4"), np.zeros(lanes, "i4")
        self.count, self.met, self.step = np.full((self.classes, lanes), 2, "i8"), [], 0
        self._share()

    def _share(self) -> None:
        """Where the classes' shares begin and end, out of 1 << SCALE and none empty, from the counts so far."""
        if self.met:
            seen = np.concatenate([kind * self.lanes + self.row for kind in self.met])
            self.count += np.bincount(seen, minlength=(self.classes + 1) * self.lanes)[: self.classes * self.lanes].reshape(self.classes, -1)
            self.met = []
        below = np.cumsum(self.count, 0)
        edge = np.zeros((self.classes + 1, self.lanes), "i2")
        edge[1:] = (below * ((1 << SCALE) - self.classes) / below[-1]).astype("i2") + np.arange(1, self.classes + 1, dtype="i2")[:, None]
        self.ends, self.edges = edge[1:], (edge[1:].astype("i4") << 16 | edge[:-1]).reshape(-1)

    def predict(self) -> None:
        """Set what is predicted, the widths of both hits and of the rest, out of ALL."""
        mark = self.last * np.int32(40503)
        self.at2 = (mark + self.mark >> 4 & TWO - 1) * self.lanes + self.row
        self.at1 = (self.last & ONE - 1) * self.lanes + self.row
        self.mark = mark >> 3
        e2, e1 = self.two.take(self.at2), self.one.take(self.at1)
        self.guess2, self.guess1, self.sure2, self.sure1 = e2 >> 2, e1 >> 2, e2 & 3, e1 & 3
        self.at = (self.sure2 << 2 | self.sure1) * self.lanes + self.row
        self.weight = self.weights.take(self.at)
        self.width2, self.width1 = (self.weight >> 16).view("i4"), (self.weight & 0xFFFF).view("i4")
        self.hits = self.width2 + self.width1
        self.rest = ALL - self.hits

    def spot(self, kind: np.ndarray, by2: np.ndarray, by1: np.ndarray, miss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, width) of class kind among the rest, of the order-2 prediction or of the order-1 one, by which mask is -1."""
        edges = self.edges.take(kind * self.lanes + self.row)
        lo, hi = self.rest * (edges & 0xFFFF) >> SCALE, self.rest * (edges >> 16) >> SCALE
        return self.hits + lo & miss | self.width2 & by1, hi - lo & miss | self.width2 & by2 | self.width1 & by1

    def update(self, ids: np.ndarray, kind: np.ndarray, is2: np.ndarray, is1: np.ndarray, by2: np.ndarray, by1: np.ndarray) -> None:
        """Learn from the ids that came; kind is the number of classes for a hit."""
        self.weights[self.at] = self.weight - (self.weight >> RATE & KEPT) + (by2.view("u4") & MOST >> RATE << 16 | by1.view("u4") & MOST >> RATE)
        fresh = (np.minimum(ids, LAST) << 2).astype("u2")
        self.two[self.at2] = fresh + is2 * (self.sure2 + (self.sure2 < 3))
        self.one[self.at1] = fresh + is1 * (self.sure1 + (self.sure1 < 3))
        self.last = ids
        self.met.append(kind)
        self.step += 1
        if self.step % SHARE_EVERY == 0 or self.step in (8, 24, 64):
            self._share()


def encode_blocks(ids: np.ndarray) -> bytes:
    """The list of the different ids (0 to 2**31 - 1) by falling frequency, then all blocks, framed one after another."""
    n = len(ids)
    if not n:
        return b""
    if int(ids.max()) < 1 << 22:
        count, place = np.bincount(ids), ids
        names = np.flatnonzero(count)
    else:
        names, place, count = np.unique(ids, return_inverse=True, return_counts=True)
    if len(names) > MOST_NAMES:
        return encode_blocks(ids[: n // 2]) + encode_blocks(ids[n // 2 :])
    order = np.argsort(-count, kind="stable")[: len(names)]
    number = np.zeros(len(count), "i4")
    number[order] = np.arange(len(names), dtype="i4")
    told = (order if place is ids else names[order]).astype("<u4").tobytes()
    lanes = max(min(LANES, -(-n // LEAST_BLOCK)), -(-n // MOST_BLOCK))
    size = -(-n // lanes)
    lanes = -(-n // size)
    grid = np.zeros(lanes * size, "i4")
    for k in range(0, n, 1 << 18):
        grid[k : min(k + (1 << 18), n)] = number.take(place[k : k + (1 << 18)])
    grid = np.ascontiguousarray(grid.reshape(lanes, size).T)
    model = Model(lanes, len(names))
    low, span = np.zeros(lanes, "i8"), np.full(lanes, SPAN)
    out_lane, out_word = [], []
    kinds = np.frexp(np.arange(len(names)) + 1.0)[1] - 1
    below = (np.arange(len(names)) + 1 - (1 << kinds)).astype("i4")
    for x in grid:
        model.predict()
        is2, is1 = model.guess2 == x, model.guess1 == x
        by2, by1 = -is2.astype("i4"), -(is1 > is2).astype("i4")
        miss = ~(by2 | by1)
        kind = kinds.take(x)
        start, width = model.spot(kind, by2, by1, miss)
        deep, bits = kind & miss, below.take(x) & miss
        unit = span >> 16
        span = unit * width >> deep
        low += unit * start + span * bits
        model.update(x, deep | model.classes & ~miss, is2, is1, by2, by1)
        at = np.flatnonzero(span < LEAST)
        while len(at):
            some, left = low.take(at), span.take(at) << 16
            out_lane.append(at.astype("u2"))
            out_word.append((some >> 32).astype("i4"))
            low[at], span[at] = (some & LOW) << 16, left
            at = at[left < LEAST]
    for _ in range(3):
        out_lane.append(model.row.astype("u2"))
        out_word.append((low >> 32).astype("i4"))
        low = (low & LOW) << 16
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    word = word[np.argsort(lane, kind="stable")]
    while len(at := np.flatnonzero(word >> 16)):  # carries go to the word before, which is of the same lane
        word[at] &= 0xFFFF
        word[at - 1] += 1
    ends = np.cumsum(np.bincount(lane, minlength=lanes))
    frames = [HEAD.pack(NAMES_MARK, len(names), zlib.crc32(told), len(told)), told]
    for k in range(lanes):
        part = word[ends[k - 1] if k else 0 : ends[k]].astype("<u2").tobytes()
        own = ids[k * size : (k + 1) * size]
        frames += [HEAD.pack(BLOCK_MARK, len(own), zlib.crc32(own.astype("<u4").tobytes()), len(part)), part]
    return b"".join(frames)


def decode_blocks(data: bytes) -> np.ndarray:
    """Ids of framed blocks; fails where a frame or a checksum is wrong."""
    groups: list[tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]] = []
    at = 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError("damaged frame")
        mark, n, crc, length = HEAD.unpack_from(data, at)
        body = data[at + HEAD.size : at + HEAD.size + length]
        at += HEAD.size + length
        if mark not in (NAMES_MARK, BLOCK_MARK) or len(body) < length or (mark == BLOCK_MARK and not groups):
            raise ValueError("damaged frame")
        if mark == BLOCK_MARK:
            groups[-1][1].append((n, crc, np.frombuffer(body, "<u2")))
        elif zlib.crc32(body) != crc or len(body) != 4 * n or not n:
            raise ValueError("checksum of the list of ids differs")
        else:
            groups.append((np.frombuffer(body, "<u4"), []))
    out = [_decode_group(names, blocks) for names, blocks in groups if blocks]
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def _decode_group(names: np.ndarray, blocks: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Ids of the blocks after one list.

    Quotients of integers are taken in double precision and cut: both sides stay below 2**48, so a quotient q is either
    whole or 1 / divisor away from the next whole number, which is more than its rounding error.
    """
    lanes = len(blocks)
    here = np.concatenate(([0], np.cumsum([len(part) for _, _, part in blocks])))[:-1]
    stream = np.concatenate([*[part for _, _, part in blocks], np.zeros(4, "<u2")]).astype("i4")
    code, span = np.zeros(lanes, "i8"), np.full(lanes, SPAN)
    for _ in range(3):
        code = code << 16 | stream.take(here, mode="clip")
        here += 1
    model = Model(lanes, len(names))
    grid = np.zeros((max(n for n, _, _ in blocks), lanes), "i4")
    for t in range(len(grid)):
        model.predict()
        unit = span >> 16
        where = np.minimum(code / unit, ALL - 1).astype("i4")
        by2 = -(where < model.width2).astype("i4")
        by1 = -(where < model.hits).astype("i4") ^ by2
        miss = ~(by2 | by1)
        # The last class whose start is not beyond: rest * end >> SCALE <= inside, solved for end.
        most = (((where - model.hits + 1 << SCALE) - 1) / model.rest).astype("i2")
        kind = np.add.reduce((model.ends <= most).view("i1"), 0, dtype="i1").astype("i4")
        start, width = model.spot(kind, by2, by1, miss)
        deep = kind & miss
        span = unit * width >> deep
        code -= unit * start
        first = (1 << deep) - 1
        bits = np.minimum(code / span, first).astype("i4")
        code -= span * bits
        x = first + bits & miss | model.guess2 & by2 | model.guess1 & by1
        grid[t] = x
        model.update(x, deep | model.classes & ~miss, model.guess2 == x, model.guess1 == x, by2, by1)
        at = np.flatnonzero(span < LEAST)
        while len(at):
            now, left = here.take(at), span.take(at) << 16
            code[at] = code.take(at) << 16 | stream.take(now, mode="clip")
            here[at], span[at] = now + 1, left
            at = at[left < LEAST]
    out = [names.take(grid[:n, k], mode="clip") for k, (n, _, _) in enumerate(blocks)]
    if any(zlib.crc32(ids.tobytes()) != crc for ids, (_, crc, _) in zip(out, blocks)):
        raise ValueError("checksum of a block differs")
    return np.concatenate(out)


LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """The process's encoder for a tokenizer file, which is used as it is loaded: strings of its added tokens are those tokens.

    A run of letters, with or without a blank in front, is one word to the pre-tokenizer, so it goes straight to the
    library's model, in the letters that the library's pre-tokenizer writes bytes with.
    """
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        tokenize, write = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str
        letters = ["\ufffe"] * 256  # of the bytes of words and of line feeds; no other byte is met
        for c in filter(re.compile(f"[\n {LETTERS}]").fullmatch, map(chr, range(256))):
            for byte, letter in zip(c.encode(), "".join(x for x, _ in write(c)), strict=True):
                letters[byte] = letter
        alphabet, plain = "".join(letters), re.compile(f" ?[{LETTERS}]+").fullmatch

        def encode(chunks: list[str]) -> Iterator[list[int]]:
            words = list(map(plain, chunks))
            others = iter(tokenizer.encode_batch_fast([x for x, word in zip(chunks, words) if not word], add_special_tokens=False))
            written = iter(codecs.charmap_decode("\n".join(compress(chunks, words)).encode(), "strict", alphabet)[0].split(alphabet[10]))
            for word in words:
                yield [t.id for t in tokenize(next(written))] if word else next(others).ids

        _ENCODERS[path] = BatchEncoder(encode, added)
    return _ENCODERS[path]


def _ended(ids: np.ndarray, ends: np.ndarray, end_id: int) -> np.ndarray:
    """ids with end_id put in at all ends."""
    out, start = np.full(len(ids) + len(ends), end_id, "i4"), 0
    for k, end in enumerate(ends.tolist()):
        out[start + k : end + k] = ids[start:end]
        start = end
    return out


FILE_SCHEMA = "part int, chunk int, n_ids long, doc_ids array<long>, counts array<long>, blocks binary"


def write_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write the ids of every document, with end_id after each, in ascending doc_id order (null ids first).

    Documents are range-partitioned by id; a file row holds whole documents of about ROW_IDS ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, chunk = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        names: list[pa.Array] = []

        def row() -> pa.RecordBatch:
            ids, each = np.concatenate(held), pa.concat_arrays([pa.array(x, pa.int64()) for x in counts])
            values = [pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(ids)], pa.int64())]
            values += [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(names), each)]
            return pa.RecordBatch.from_arrays([*values, pa.array([encode_blocks(ids)], pa.binary())], ["part", "chunk", "n_ids", "doc_ids", "counts", "blocks"])

        for batch in uncollected(batches):
            for first, ids, ends in encode(batch.column(1)):
                held.append(_ended(ids, ends, end_id))
                counts.append(np.diff(ends, prepend=0) + 1)
                names.append(batch.column(0)[first : first + len(ends)])
                if sum(map(len, held)) >= ROW_IDS:
                    yield row()
                    held, counts, names, chunk = [], [], [], chunk + 1
        if held:
            yield row()

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, names, counts, blocks in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                ids = decode_blocks(blocks)
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(base + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    part_base = parts.select("part", F.coalesce(F.sum("n").over(earlier().orderBy("part")), F.lit(0)).alias("part_base"))
    inside = files.select("part", "chunk", F.coalesce(F.sum("n_ids").over(earlier("part").orderBy("chunk")), F.lit(0)).alias("before"))
    base = inside.join(part_base, "part").select("part", "chunk", (F.col("before") + F.col("part_base")).alias("base"))
    rows = files.select("part", "chunk", "doc_ids", "counts", "blocks").join(base, ["part", "chunk"])
    return rows.select("base", "doc_ids", "counts", "blocks").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Files written to the shared checkpoint folder and read back.  A null text counts as empty; repeated rows stay."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/token-files-{uuid.uuid4().hex}"
    write_files(docs, path, tokenizer_path)
    return read_files(spark.read.schema(FILE_SCHEMA).parquet(path))
