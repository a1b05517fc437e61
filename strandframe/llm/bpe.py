"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The merges are compiled into a nondeterministic transducer: it walks the trie of the vocabulary and
may end a token wherever the token may follow the one before.  A sequence of tokens is what the merges
give exactly if each adjacent pair is, and a pair is unless some merge across its border comes
before the merges that close both sides.  Every prefix has one such sequence, so of the live
hypotheses at most one stands at a token's end.  Determinising keeps the set of hypotheses with the
tokens not yet emitted; what all of them share is emitted.  A hypothesis lives no longer than the
longest token, which bounds the lookahead.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import BatchEncoder, uncollected

START = -1  # before the first token


class MergeTransducer:
    """Encodes byte strings by the merge order that ranks state."""

    def __init__(self, ranks: dict[bytes, int], room: int = 200_000):
        self.ranks, self.room = ranks, room
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.next: list[dict[int, int]] = [{}]
        self.token: list[int] = [START]
        for word, rank in ranks.items():
            node = 0
            for byte in word:
                if (child := self.next[node].get(byte)) is None:
                    child = self.next[node][byte] = len(self.next)
                    self.next.append({})
                    self.token.append(START)
                node = child
            self.token[node] = rank
        self.pairs = {ranks[a] << 32 | ranks[b]: rank for word, rank in ranks.items() for i in range(1, len(word)) if (a := word[:i]) in ranks and (b := word[i:]) in ranks}
        self._last_merge: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._may_follow: dict[tuple[int, int], bool] = {}
        self._forget()

    def _forget(self) -> None:
        """Drop the determinised states; they are built again when met."""
        start = ((), START, 0)
        self.states: dict[tuple, int] = {(start,): 0}
        self.members: list[tuple] = [(start,)]
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}  # by state << 8 | byte

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge closes a token; None for one byte."""
        if token not in self._last_merge:
            word, ranks = self.bytes_of[token], self.ranks
            parts = [word[i : i + 1] for i in range(len(word))]
            while len(parts) > 2:
                best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
                parts[best : best + 2] = [parts[best] + parts[best + 1]]
            self._last_merge[token] = (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else None
        return self._last_merge[token]

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, merge that makes it) of all that ever stand at the left (0) or right (1) border, from the last to a single byte."""
        if (token, side) not in self._spines:
            out, inner = [], token
            while parts := self.last_merge(inner):
                out.append((inner, inner))
                inner = parts[side]
            self._spines[token, side] = [*out, (inner, -1)]
        return self._spines[token, side]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging left + right gives just these two tokens; of equal merges the leftmost is first.

        Merges are undone from the last on; a and b are what faces each other across the border, and `ends` is the
        merge that ends this: one of a + b that is made between comes first.
        """
        if len(self._may_follow) > 400_000:
            self._may_follow.clear()
        pairs, before, after = self.pairs, self.spine(left, 1), self.spine(right, 0)
        i = j = 0
        ends, ok = 1 << 60, True
        while True:
            (a, a_made), (b, b_made) = before[i], after[j]
            if (merge := pairs.get(a << 32 | b)) is not None and a_made < merge and b_made < merge and merge < ends:
                ok = False
                break
            if a_made < 0 and b_made < 0:
                break
            # a + b made by the merge that makes the right side's next part is further left, so it comes first.
            if b_made >= a_made:
                ends, j = b_made + 1, j + 1
            else:
                ends, i = a_made, i + 1
        self._may_follow[left, right] = ok
        return ok

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Determinise one step: the state after byte, and the tokens that are now certain."""
        live, arcs, ends, follow = [], self.next, self.token, self._may_follow
        for held, last, node in self.members[state]:
            if (child := arcs[node].get(byte)) is None:
                continue
            if arcs[child]:
                live.append((held, last, child))
            if (token := ends[child]) == START:
                continue
            if last == START or (self.may_follow(last, token) if (ok := follow.get((last, token))) is None else ok):
                live.append(((*held, token), token, 0))
        if len(live) == 1:
            out = live[0][0]
            key = (((), *live[0][1:]),)
        else:
            least, most = min(x[0] for x in live), max(x[0] for x in live)
            shared = next((i for i, (x, y) in enumerate(zip(least, most)) if x != y), min(len(least), len(most)))
            out = least[:shared]
            key = tuple((held[shared:], last, node) for held, last, node in live) if shared else tuple(live)
        if (to := self.states.get(key)) is None:
            to = self.states[key] = len(self.members)
            self.members.append(key)
        self.arcs[state << 8 | byte] = (to, out)
        return to, out

    def encode(self, word: bytes) -> list[int]:
        """Tokens of one pre-token; none for an empty one."""
        if word in self.ranks:
            return [self.ranks[word]]
        if len(self.members) > self.room:
            self._forget()
        state, out, arcs = 0, [], self.arcs
        for byte in word:
            arc = arcs.get(state << 8 | byte) or self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        return out + list(next(held for held, _, node in self.members[state] if node == 0)) if word else []


class Utf8Machine:
    """Incremental UTF-8 decoding: whole characters come out, an unfinished one is held as state."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = 0
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue
            need = 4 if byte >= 0xF0 else 3 if byte >= 0xE0 else 2 if byte >= 0xC0 else 1
            keep = back if need > back else 0
            break
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines of base64 token and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder of whole texts and decoder of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = MergeTransducer(ranks)
        self.words = regex.compile(pattern)
        self.batches = BatchEncoder(lambda chunks: map(self.pieces, chunks))
        size = max(ranks.values()) + 1
        self.bytes_of = pa.array([self.transducer.bytes_of.get(i, b"") for i in range(size)], pa.binary())
        self.name_of = pa.array([b"%d " % i for i in range(size)], pa.binary())

    def pieces(self, text: str) -> list[int]:
        """Tokens of a text, by the matches of the pattern."""
        return list(chain.from_iterable(self.transducer.encode(w.encode("utf-8", "replace")) for w in self.words.findall(text)))

    def encode(self, text: str) -> list[int]:
        return self.batches.one(text)

    def decode(self, ids: Sequence[int], step: int = 16384) -> Iterator[str]:
        """Text of ids, in pieces that hold whole characters."""
        machine = Utf8Machine()
        for at in range(0, len(ids), step):
            yield machine.feed(_spelled(self.bytes_of, ids[at : at + step]))
        yield machine.finish()

    def named(self, ids: Sequence[int], step: int = 1 << 20) -> Iterator[bytes]:
        """Decimal ids with a blank between, in pieces."""
        for at in range(0, len(ids), step):
            some = _spelled(self.name_of, ids[at : at + step])
            yield some if at + step < len(ids) else some[:-1]


def _spelled(table: pa.Array, ids: Sequence[int]) -> bytes:
    """The entries of a table for all ids, one after another."""
    taken = table.take(pa.array(ids, pa.int32()))
    ends = np.frombuffer(taken.buffers()[1], "i4")
    return memoryview(taken.buffers()[2])[ends[taken.offset] : ends[taken.offset + len(taken)]].tobytes() if len(taken) else b""


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The process's codec for a file of ranks; kept between batches and tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS.clear()
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs.

    ranks_path: the file of ranks, at the same place on every machine.  A null text counts as empty:
    no token, and the digest of nothing.  Repeated rows stay; an empty table gives an empty one.
    """

    def digest(pieces: Iterator[bytes]) -> str:
        made = hashlib.sha256()
        for piece in pieces:
            made.update(piece)
        return made.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in uncollected(batches):
            for first, ids, ends in coder.batches(batch.column(1)):
                starts = [0, *ends[:-1]]
                own = [ids[a:b] for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[first : first + len(own)], pa.array(map(len, own), pa.int64()), pa.array([digest(coder.named(x)) for x in own], pa.string()),
                        pa.array([digest(piece.encode("utf-8") for piece in coder.decode(x)) for x in own], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
