"""Suffix ranks by prefix doubling over blocks of the text, and the tables read off them.

The text is held in blocks of codes, the ranks in blocks beside them that stay in their partitions; only those suffixes
that still share a rank are sent about, many in one record with their columns laid out in planes of bytes, which
shuffles compress.  Large steps are taken in several passes over ranges of ranks, so little lies on disk at once.
All members of a rank meet in one task.  Needs numpy and pyarrow.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, TASK = 1 << 18, 1 << 21  # symbols in a block of the text, and of a task
CHUNK = 1 << 16  # rows of the suffix array in one record
WALK = 1 << 22  # rows of the suffix array whose symbols a task of a walk holds
SAMPLES = 64  # keys that a block gives for the ranges of the first pass
FIRST_PASSES, SENT = 6, 0.12  # passes of the first step; the share of suffixes that a later pass may send


def _planes(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each number, all lowest bytes first."""
    return np.ascontiguousarray(values.astype("<i8").view("u1").reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), "u1")
    out[:, :width] = np.frombuffer(data, "u1").reshape(width, -1).T
    return out.view("<i8").ravel()


def _rising(values: np.ndarray, least: int = 4) -> tuple[int, bytes]:
    """Numbers that never fall: the first and the differences, of `least` bytes if they fit."""
    steps = np.diff(values)
    most = int(steps.max()) if steps.size else 0
    return int(values[0]), _planes(steps, 8 if most >> 32 else 4 if most >> 8 * least else least)


def _risen(first: int, data: bytes, n: int) -> np.ndarray:
    out = np.empty(n, "i8")
    out[0] = first
    if n > 1:
        out[1:] = _numbers(data, len(data) // (n - 1))
    return np.cumsum(out)


def _groups(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of runs of equal values."""
    if values.size:
        edges = np.flatnonzero(values[1:] != values[:-1]) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True):
            yield int(values[a]), a, z


def _starts(fresh: np.ndarray) -> np.ndarray:
    """For each place the last one at which fresh is true."""
    return np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0))


def _compact(size: int) -> Callable:
    """(b, at, codes): runs of consecutive symbols inside a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, code = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype("u1")
            if not len(pos):
                continue
            steps = np.diff(pos)
            if (steps < 0).any():
                order = np.argsort(pos, kind="stable")
                pos, code = pos[order], code[order]
                steps = np.diff(pos)
            edges = np.flatnonzero((steps != 1) | (pos[1:] % size == 0)) + 1
            starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(pos)]
            yield pa.RecordBatch.from_arrays([pa.array(pos[starts] // size), pa.array(pos[starts] % size), pa.array([code[a:z].tobytes() for a, z in zip(starts, ends, strict=True)], pa.binary())], ["b", "at", "codes"])

    return run


def _assembled(rows: Iterator) -> Iterator[tuple[int, bytearray]]:
    held: dict[int, list] = {}
    for b, run in rows:
        held.setdefault(b, []).append(run)
    for b, runs in held.items():
        yield b, bytearray(b"".join(codes for _, codes in sorted(runs)))


def _swept(df: DataFrame) -> None:
    """Let Spark drop the shuffles and checkpoints that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _by(records: RDD, n: int) -> RDD:
    """Records (number, payload) dealt to the partition of that number."""
    return records.partitionBy(n, lambda x: x)


def _beside(left: RDD, right: RDD, merge: Callable) -> RDD:
    """merge(rows, rows) of partitions with the same number."""
    return left.glom().zip(right.glom()).flatMap(lambda pair: merge(*pair))


def _keys(codes: bytes, head: bytes, q: int, k: int) -> np.ndarray:
    """The next k symbols at each place as one number to the base q; what lies past the end is 0."""
    n = len(codes)
    text = np.zeros(n + k, "i8")
    known = np.frombuffer(bytes(codes) + head[:k], "u1")
    text[: len(known)] = known
    out, grown, width, at = np.zeros(n, "i8"), text, 1, 0
    for bit in range(k.bit_length()):
        if k >> bit & 1:
            # The parts of k's binary form, shortest first.
            out = out * q**width + grown[at : at + n]
            at += width
        if (k >> (bit + 1)) == 0:
            break
        longer = grown * q**width
        longer[:-width] += grown[width:]
        grown, width = longer, 2 * width
    return out


def _ranked(records: Iterator) -> Iterator[tuple[int, tuple]]:
    """New ranks of records (part, (b, n, places, r, second)): r and the number of its members whose second is smaller."""
    held = [x for _, x in records]
    by_part: dict[int, list] = {}
    for part, *x in held:
        by_part.setdefault(part, []).append(x)
    for rows in by_part.values():
        sizes = [x[1] for x in rows]
        r = np.concatenate([np.full(x[1], x[3], "i8") if isinstance(x[3], int) else _risen(*x[3], x[1]) for x in rows])
        second = np.concatenate([x[4] if isinstance(x[4], np.ndarray) else _risen(*x[4], x[1]) for x in rows])
        order = np.lexsort((second, r))
        r, second = r[order], second[order]
        group = np.r_[True, r[1:] != r[:-1]]
        fresh = group | np.r_[True, second[1:] != second[:-1]]
        rank, alone = np.empty(len(r), "i8"), np.empty(len(r), bool)
        rank[order] = r + _starts(fresh) - _starts(group)
        alone[order] = fresh & np.r_[fresh[1:], True]
        for (b, n, places, *_), z in zip(rows, np.cumsum(sizes).tolist(), strict=True):
            mine = rank[z - n : z]
            yield b, (n, places, int(mine.min()), _planes(mine - mine.min(), 4 if int(mine.max() - mine.min()) >> 32 == 0 else 8), np.packbits(alone[z - n : z]).tobytes())


def _kept(blocks: RDD) -> RDD:
    """Written to the checkpoint folder now, and computed once only.

    What is returned doesn't refer to what it was made of, as blocks does, so that the shuffles and the state before can go.
    """
    blocks.checkpoint()
    blocks._jrdd.rdd().doCheckpoint()
    return RDD(blocks._jrdd, blocks.ctx, blocks._jrdd_deserializer)


def _updated(state: list, updates: list) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Blocks (b, ranks, live) with the ranks that came for them."""
    by: dict[int, list] = {}
    for b, x in updates:
        by.setdefault(b, []).append(x)
    for b, ranks, live in state:
        ranks, live = ranks.copy(), np.unpackbits(live, count=len(ranks))
        for n, places, low, data, alone in by.get(b, ()):
            at = _numbers(places, 3)
            ranks[at] = _numbers(data, len(data) // n) + low
            live[at] = 1 - np.unpackbits(np.frombuffer(alone, "u1"), count=n)
        yield b, ranks, np.packbits(live)


def ordered(symbols: DataFrame, block: int = BLOCK, task: int = TASK, chunk: int = CHUNK) -> DataFrame:
    """(row, places, before): the suffix array of (text_pos, code), `chunk` rows in each row.

    row is the number of the first; places has the text positions and before the codes of the symbols before them, as bytes.
    """
    from .index import cut

    spark = symbols.sparkSession
    if block > 1 << 24:
        raise ValueError("places in a block have three bytes")
    runs = symbols.select(symbols["text_pos"].cast("long"), symbols["code"].cast("int")).mapInArrow(_compact(block), "b long, at long, codes binary").rdd
    some = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = _by(runs.map(lambda x: (x[0], (x[1], bytes(x[2])))), some).mapPartitions(_assembled)
    cut(symbols.sparkSession.range(1))  # names the shared folder
    text = _kept(text)
    _swept(symbols)
    ends = {b: (n, head, last, top) for b, n, head, last, top in text.map(lambda x: (x[0], len(x[1]), bytes(x[1][:64]), x[1][-1], max(x[1]))).collect()}
    if not ends:
        return spark.createDataFrame([], "row long, places binary, before binary")
    size = sum(x[0] for x in ends.values())
    q = max(2, max(x[3] for x in ends.values()) + 1)
    k = next(k for k in range(62, 0, -1) if q**k < 1 << 63)
    wide, parts = 4 if size < 1 << 32 else 8, max(1, -(-size // task))
    dealt = max(some, parts)
    heads = {b: b"".join(ends[c][1] for c in range(b + 1, b + 1 + k) if c in ends)[:k] for b in ends}
    lasts = {b: ends[(b or len(ends)) - 1][2] for b in ends}
    lines = _kept(_by(text, dealt).map(lambda x: x)) if dealt > some else text
    del text
    _swept(symbols)

    each = max(SAMPLES, -(-64 * parts // len(ends)))
    drawn = lines.flatMap(lambda x: np.random.default_rng(x[0]).choice(_keys(x[1], heads[x[0]], q, k), each).tolist()).collect()
    edges = np.unique(np.sort(np.array(drawn, "i8"))[[len(drawn) * i // parts for i in range(1, parts)]]) if parts > 1 else np.array([], "i8")
    part_of = lambda keys: np.searchsorted(edges, keys, "right")
    counts = lines.map(lambda x: np.bincount(part_of(_keys(x[1], heads[x[0]], q, k)), minlength=parts)).treeReduce(lambda a, b: a + b)
    base = np.r_[0, np.cumsum(counts)].tolist()

    def first(low: int, high: int) -> Callable:
        def run(x) -> Iterator[tuple[int, tuple]]:
            keys = _keys(x[1], heads[x[0]], q, k)
            at = np.flatnonzero((part_of(keys) >= low) & (part_of(keys) < high))
            at = at[np.argsort(keys[at], kind="stable")]
            keys = keys[at]
            for part, a, z in _groups(part_of(keys)):
                yield part, (part, x[0], z - a, _planes(at[a:z], 3), base[part], _rising(keys[a:z]))

        return run

    state, passes = None, min(FIRST_PASSES, parts)
    for i in range(passes):
        sent = lines.flatMap(first(parts * i // passes, parts * (i + 1) // passes))
        news = _by(_by(sent, dealt).mapPartitions(_ranked), dealt)
        blank = lines.map(lambda x: (x[0], np.zeros(len(x[1]), f"<u{wide}"), np.packbits(np.ones(len(x[1]), "u1")))) if state is None else state
        state = _kept(_beside(blank, news, _updated))
        del sent, news, blank
        _swept(symbols)

    h, final = k, max(ends)
    while live := state.map(lambda x: int(np.bitwise_count(x[2]).sum())).sum():
        passes = min(parts, max(1, -(-live // max(1, int(SENT * size)))))
        for i in range(passes):
            low, high = size * i // passes, size * (i + 1) // passes

            def asked(x, h=h, low=low, high=high) -> Iterator[tuple[int, tuple]]:
                b, ranks, live = x
                at = np.flatnonzero(np.unpackbits(live, count=len(ranks)))
                r = ranks[at].astype("i8")
                mine = (r >= low) & (r < high)
                at, r = at[mine], r[mine]
                for there, a, z in _groups(np.minimum((b * block + at + h) // block, final)):
                    yield there, (b, z - a, _rising(at[a:z]), _planes(r[a:z], wide))

            def told(blocks: list, asks: list, h=h) -> Iterator[tuple[int, tuple]]:
                by: dict[int, list] = {}
                for there, x in asks:
                    by.setdefault(there, []).append(x)
                for there, ranks, live in blocks:
                    for b, n, places, r in by.get(there, ()):
                        at, r = _risen(*places, n), _numbers(r, wide)
                        to = b * block + at + h
                        # Of two suffixes that end, the shorter one is smaller.
                        second = np.where(to < size, ranks[np.minimum(to - there * block, len(ranks) - 1)].astype("i8"), size - 1 - to)
                        order = np.argsort(r, kind="stable")
                        at, r, second = at[order], r[order], second[order]
                        for part, a, z in _groups(r * parts // size):
                            yield part, (part, b, z - a, _planes(at[a:z], 3), _rising(r[a:z]), second[a:z].astype("i4") if size < 1 << 31 else second[a:z])

            asks = _by(state.flatMap(asked), dealt)
            news = _by(_by(_beside(state, asks, told), dealt).mapPartitions(_ranked), dealt)
            state = _kept(_beside(state, news, _updated))
            del asks, news
            _swept(symbols)
        h *= 2

    per = max(1, task // chunk) * chunk

    def sorted_out(blocks: list, codes: list) -> Iterator[tuple[int, tuple]]:
        held = {x[0]: x[1] for x in codes}
        for b, ranks, live in blocks:
            r = ranks.astype("i8")
            before = np.frombuffer(bytes([lasts[b]]) + bytes(held[b][:-1]), "u1")
            order = np.argsort(r)
            r = r[order]
            for part, a, z in _groups(r // per):
                yield part, (part, b, z - a, _rising(r[a:z]), _planes(order[a:z], 3), before[order[a:z]].tobytes())

    def laid_out(records: Iterator) -> Iterator[tuple[int, bytearray, bytearray]]:
        by: dict[int, list] = {}
        for part, x in records:
            by.setdefault(part, []).append(x[1:])
        for part, rows in by.items():
            n = min(size - part * per, per)
            places, before = np.empty(n, f"<u{wide}"), np.empty(n, "u1")
            for b, m, r, at, codes in rows:
                row = _risen(*r, m) - part * per
                places[row], before[row] = b * block + _numbers(at, 3), np.frombuffer(codes, "u1")
            for a in range(0, n, chunk):
                yield part * per + a, bytearray(places[a : a + chunk].tobytes()), bytearray(before[a : a + chunk].tobytes())

    laid = _by(_beside(state, lines, sorted_out), dealt).mapPartitions(laid_out)
    out = cut(spark.createDataFrame(laid, "row long, places binary, before binary"))
    del laid, state, lines
    _swept(symbols)
    return out


def spread(table: DataFrame, columns: str, made: Callable[[int, np.ndarray, np.ndarray, tuple], list[np.ndarray]]) -> DataFrame:
    """Rows of these columns from each row of ordered(): made(row, places, before, other columns)."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, places, before, *more in zip(*batch.columns, strict=True):
                before = np.frombuffer(before.as_py(), "u1")
                data = places.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made(row.as_py(), np.frombuffer(data, f"<u{len(data) // len(before)}").astype("i8"), before, tuple(x.as_py() for x in more))], names)

    return table.mapInArrow(run, columns)


def tallied(table: DataFrame, codes: int = 16) -> tuple[DataFrame, list[int]]:
    """ordered() with earlier, how often each code stands in `before` in all rows of smaller numbers, as longs; and its totals.

    The driver gets and sends 16 counts for each 65,536 rows of the suffix array.
    """
    counted = table.rdd.map(lambda x: (x[0], np.bincount(np.frombuffer(x[2], "u1"), minlength=codes))).collect()
    counted.sort(key=lambda x: x[0])
    sums = np.cumsum([np.zeros(codes, "i8"), *(n for _, n in counted)], axis=0).astype("<i8")
    earlier = [(row, bytearray(sums[i].tobytes())) for i, (row, _) in enumerate(counted)]
    found = table.sparkSession.createDataFrame(earlier, "row long, earlier binary")
    return table.join(F.broadcast(found), "row"), sums[-1].tolist()


def _earlier(more: tuple) -> np.ndarray:
    return np.frombuffer(more[0], "<i8")


def places(table: DataFrame) -> DataFrame:
    """(row, text_pos): the suffix array."""
    return spread(table, "row long, text_pos long", lambda row, at, before, _: [np.arange(row, row + len(at)), at])


def transform(table: DataFrame) -> DataFrame:
    """(row, code): the symbol before each suffix, the last one before the first."""
    return spread(table, "row long, code int", lambda row, at, before, _: [np.arange(row, row + len(at)), before.astype("i4")])


def samples(table: DataFrame, rate: int = 32) -> DataFrame:
    """(row, text_pos) of every rate-th text position and of each sequence's start, which an end mark stands before."""

    def made(row: int, at: np.ndarray, before: np.ndarray, _: tuple) -> list[np.ndarray]:
        kept = np.flatnonzero((at % rate == 0) | (before == 0))
        return [row + kept, at[kept]]

    return spread(table, "row long, text_pos long", made)


def resolved(table: DataFrame, rate: int = 32, per: int = WALK) -> DataFrame:
    """(row, text_pos) of every row, by steps of the LF mapping from each row to a sampled one, walked from the samples' end.

    The row at text position p + 1 is the one whose step leads to the row at p: if that is the k-th row that begins with a symbol, the
    k-th row before which that symbol stands.  All samples walk in lockstep, up to rate - 1 times; a task holds the symbols of `per` rows, and only
    (k, position) are sent.  A walk ends before the next sample: after an end mark, or before a multiple of rate.
    """
    spark = table.sparkSession
    size = table.agg(F.sum(F.length("before"))).first()[0]
    if not size:
        return spark.createDataFrame([], "row long, text_pos long")
    here = spark.range(0)
    parts, wide = -(-size // per), 4 if size < 1 << 32 else 8

    def begun(x) -> Iterator[tuple[int, tuple]]:
        row, places, before = x
        symbols = np.frombuffer(before, "u1")
        at = np.frombuffer(places, f"<u{len(places) // len(before)}").astype("i8")
        kept = np.flatnonzero((at % rate == 0) | (symbols == 0))
        for part, a, z in _groups((row + np.arange(len(at))) // per):
            mine = kept[(kept >= a) & (kept < z)]
            yield part, (part, row + a - part * per, bytes(before[a:z]), _planes(row + mine - part * per, 4), _planes(at[mine], wide))

    def gathered(rows: Iterator) -> Iterator[tuple[int, bytes, tuple | None]]:
        """(part, symbols, what _met gives of its samples)."""
        by: dict[int, list] = {}
        for part, *x in (x for _, x in rows):
            by.setdefault(part, []).append(x)
        for part, found in by.items():
            found.sort(key=lambda x: x[0])
            rows_, places = (np.concatenate([_numbers(x[i], w) for x in found]) for i, w in ((2, 4), (3, wide)))
            yield part, b"".join(x[1] for x in found), met(part, rows_, places)

    def met(part: int, at: np.ndarray, places: np.ndarray) -> tuple | None:
        return (part, len(at), _rising(at, 2), _planes(places, wide)) if len(at) else None

    blocks = _kept(_by(table.select("row", "places", "before").rdd.flatMap(begun), parts).mapPartitions(gathered))
    del table
    _swept(here)
    tallies = dict(blocks.map(lambda x: (x[0], np.bincount(np.frombuffer(x[1], "u1"), minlength=16))).collect())
    earlier = np.cumsum([np.zeros(16, "i8"), *(tallies[p] for p in range(parts))], axis=0)
    begins = np.r_[0, np.cumsum(earlier[-1])]

    def sent(x: tuple) -> Iterator[tuple[int, tuple]]:
        part, n, at, places = x
        row, place = _risen(*at, n) + part * per, _numbers(places, wide)
        on = (row >= begins[1]) & ((place + 1) % rate != 0)
        row, place = row[on], place[on]
        for code, a, z in _groups(np.searchsorted(begins, row, "right") - 1):
            k = row[a:z] - begins[code]
            for to, b, y in _groups(np.searchsorted(earlier[:, code], k, "right") - 1):
                yield to, (code, y - b, _rising(k[b:y] - earlier[to, code]), _planes(place[a + b : a + y], wide))

    def stepped(held: list, came: list) -> Iterator[tuple]:
        for part, symbols, _ in held:
            symbols, by = np.frombuffer(symbols, "u1"), {}
            for code, n, k, places in (x for _, x in came):
                at, place = by.setdefault(code, ([], []))
                at.append(_risen(*k, n))
                place.append(_numbers(places, wide) + 1)
            if by:
                rows = np.concatenate([np.flatnonzero(symbols == code)[np.concatenate(at)] for code, (at, _) in by.items()])
                order = np.argsort(rows)
                yield met(part, rows[order], np.concatenate([p for _, place in by.values() for p in place])[order])

    steps = [blocks.map(lambda x: x[2]).filter(lambda x: x is not None)]
    for _ in range(rate - 1):
        steps.append(_kept(_beside(blocks, _by(steps[-1].flatMap(sent), parts), stepped)))
        _swept(here)
    laid = spark.sparkContext.union(steps).coalesce(max(parts, 12)).map(lambda x: (x[0] * per + x[2][0], x[1], bytearray(x[2][1]), bytearray(x[3])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n, more, places in zip(*batch.columns, strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(_risen(row.as_py(), more.as_py(), n.as_py())), pa.array(_numbers(places.as_py(), wide))], ["row", "text_pos"])

    return spark.createDataFrame(laid, "row long, n int, more binary, places binary").mapInArrow(run, "row long, text_pos long")


def lf(table: DataFrame) -> DataFrame:
    """(row, code, lf): where each row's symbol stands in the first column."""
    tall, totals = tallied(table)
    smaller = np.r_[0, np.cumsum(totals)].tolist()

    def made(row: int, at: np.ndarray, before: np.ndarray, more: tuple) -> list[np.ndarray]:
        to, earlier = np.empty(len(at), "i8"), _earlier(more)
        for c in np.unique(before).tolist():
            mine = np.flatnonzero(before == c)
            to[mine] = smaller[c] + earlier[c] + np.arange(len(mine))
        return [np.arange(row, row + len(at)), before.astype("i4"), to]

    return spread(tall, "row long, code int, lf long", made)


def checkpoints(table: DataFrame, block: int = 4096) -> DataFrame:
    """(block, code, before): how often each symbol that occurs stands before each block, whose size divides a record's."""
    tall, totals = tallied(table)
    known = [c for c, n in enumerate(totals) if n]

    def made(row: int, at: np.ndarray, before: np.ndarray, more: tuple) -> list[np.ndarray]:
        starts, earlier = np.arange(0, len(at), block), _earlier(more)
        sums = [earlier[c] + np.r_[0, np.cumsum(before == c)][starts] for c in known]
        return [np.tile((row + starts) // block, len(known)), np.repeat(np.array(known, "i4"), len(starts)), np.concatenate(sums)]

    return spread(tall, "block long, code int, before long", made)


def ranks(table: DataFrame, codes: list[int]) -> DataFrame:
    """(code, i, rank): how often each of these codes stands in rows before i, for i from 1 to the length of the text."""
    tall, _ = tallied(table)

    def made(row: int, at: np.ndarray, before: np.ndarray, more: tuple) -> list[np.ndarray]:
        i, earlier = np.arange(row + 1, row + len(at) + 1), _earlier(more)
        return [np.repeat(np.array(codes, "i4"), len(i)), np.tile(i, len(codes)), np.concatenate([earlier[c] + np.cumsum(before == c) for c in codes])]

    return spread(tall, "code int, i long, rank long", made)
