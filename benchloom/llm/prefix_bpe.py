"""Byte-level BPE by prefix dynamic programming, exact under appends and edits.

For every prefix of a piece exactly one token can be the last of that prefix's encoding; it is
the token t, ending there, whose predecessor (the last token of the prefix before t) and t stay
apart when their joint bytes are encoded.  Storing that token per prefix gives the encoding of
every prefix, so appended bytes only add entries, and after an edit entries are computed anew
only until they agree with the old ones for as long as a token can be.

A whole text is cut by the pattern first.  Words met before are looked up; new ones are taken in
sorted order, so that each keeps the entries of the prefix it shares with the one before.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.llm.chunks import WordCache
from benchloom.llm.common import held, pick

CACHED_PAIRS = 300_000
TOKEN_BITS = 24


class Ranks:
    """A vocabulary of byte strings with merge ranks, as tiktoken files hold it."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.apart: dict[int, bool] = {}  # by both ids in one number
        self.finder = ahocorasick.Automaton()
        for b, i in ranks.items():
            if len(b) == 1 or self.merge(b) == [i]:  # others never come out of a merge
                self.finder.add_word(b.decode("latin-1"), (i, len(b)))
        self.finder.make_automaton()

    @classmethod
    def load(cls, path: str) -> Ranks:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def merge(self, data: bytes) -> list[int]:
        """Plain byte-pair merging, lowest rank first; for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def stay_apart(self, left: int, right: int) -> bool:
        pair = left << TOKEN_BITS | right
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) >= CACHED_PAIRS:
                self.apart.clear()
            known = self.apart[pair] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return known


class PrefixTable:
    """The last token of every prefix of a piece; ``last[i]`` is that of the first i bytes."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self.ranks, self.data, self.last = ranks, b"", [-1]
        self.append(data)

    def _fill(self, upto: int, stop: Callable[[int], bool] | None = None) -> int:
        """Extends ``last`` to ``upto`` bytes; returns where ``stop`` ended it, or ``upto``."""
        last = self.last
        begin = len(last) - 1
        base = max(0, begin - self.ranks.longest + 1)
        window = self.data[base:upto].decode("latin-1")
        apart, known = self.ranks.stay_apart, self.ranks.apart
        done = begin
        for end, (token, size) in self.ranks.finder.iter(window):
            at = base + end + 1
            if at <= done or (start := at - size) < 0:
                continue
            if start:
                before = last[start]
                ok = known.get(before << TOKEN_BITS | token)
                if ok is None:
                    ok = apart(before, token)
                if not ok:
                    continue
            last.append(token)
            done = at
            if stop and stop(at):
                return at
        if done != upto:
            raise ValueError("a byte has no token of its own")
        return done

    def append(self, data: bytes) -> None:
        self.data += data
        self._fill(len(self.data))

    def become(self, data: bytes) -> None:
        """The table of other bytes, by appending to the prefix both share."""
        shared, most = 0, min(len(data), len(self.data))
        while shared < most and data[shared] == self.data[shared]:
            shared += 1
        self.data = data[:shared]
        del self.last[shared + 1 :]
        self.append(data[shared:])

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Bytes ``start`` to ``end`` become ``data``; returns how many prefixes were computed anew."""
        old, shift, same = self.last, len(data) - (end - start), 0
        self.data = self.data[:start] + data + self.data[end:]
        self.last = old[: start + 1]
        first_old = start + len(data)

        def agreed(at: int) -> bool:
            nonlocal same
            same = same + 1 if at > first_old and self.last[at] == old[at - shift] else 0
            return same >= self.ranks.longest

        upto = self._fill(len(self.data), agreed)
        self.last += old[upto - shift + 1 :]
        return upto - start

    def ids(self, upto: int | None = None) -> list[int]:
        """The encoding of the first ``upto`` bytes, by default of all."""
        at, out, token = len(self.data) if upto is None else upto, [], self.ranks.token
        while at:
            out.append(self.last[at])
            at -= len(token[out[-1]])
        return out[::-1]


class TextEncoder:
    """Whole texts to ids and back: the pattern's matches are encoded one by one."""

    def __init__(self, ranks: Ranks, pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.table = PrefixTable(ranks)
        self.cache = WordCache(self.words, self.text)

    def piece(self, piece: str) -> list[int]:
        """A match that is a token itself is that token; else the table's encoding."""
        data = piece.encode("utf-8")
        whole = self.ranks.ranks.get(data)
        if whole is not None:
            return [whole]
        self.table.become(data)
        return self.table.ids()

    def text(self, text: str) -> bytes:
        return np.array([i for piece in self.pattern.findall(text) for i in self.piece(piece)], np.int32).tobytes()

    def words(self, words: list[str]) -> Iterator[bytes]:
        for word in words:
            if word[0] == " " and word[1:].isalpha():  # one match of the pattern
                yield array("i", self.piece(word)).tobytes()
            else:
                yield self.text(word)

    def encode(self, text: str) -> bytes:
        """The ids of one text as int32 bytes."""
        return next(self.cache.encode([text]))

    def edit(self, text: str, start: int, end: int, new: str) -> tuple[str, list[tuple[int, int]], int]:
        """The edited text, its pieces as (start, end), and how many of them were cut anew.

        Pieces before the one in front of the edit stay; after it cutting goes on until a piece
        starts where an old one did.
        """
        spans = [m.span() for m in self.pattern.finditer(text)]
        after = text[:start] + new + text[end:]
        shift = len(new) - (end - start)
        keep = max(0, sum(b <= start for _, b in spans) - 1)
        while keep and text[slice(*spans[keep - 1])].isspace():  # a run of white space is cut by what follows it
            keep -= 1
        out = spans[:keep]
        starts = {a + shift: k for k, (a, _) in enumerate(spans) if a >= end}
        fresh = 0
        for m in self.pattern.finditer(after, out[-1][1] if out else 0):
            if m.start() >= start + len(new) and (k := starts.get(m.start())) is not None:
                return after, out + [(a + shift, b + shift) for a, b in spans[k:]], fresh
            out.append(m.span())
            fresh += 1
        return after, out, fresh


def text_encoder(path: str, pattern: str) -> TextEncoder:
    return held(("bpe", path, pattern), lambda: TextEncoder(Ranks.load(path), pattern))


def _ids_of(own: TextEncoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of a batch (doc_id, text), some rows at a time."""
    for begin in range(0, batch.num_rows, 512):
        part = batch.slice(begin, 512)
        raw = list(own.cache.encode(t.as_py() or "" for t in part.column(1)))
        offsets = np.cumsum([0, *[len(r) // 4 for r in raw]]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
        yield pa.record_batch([part.column(0), ids], names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; a null or empty text has no ids.  No row is moved.

    Repeated rows and null ids come out as they went in; other columns are left behind; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_encoder(path, pattern)
        for batch in batches:
            yield from _ids_of(own, batch)

    return pick(docs, **{id_col: "bigint", text_col: "string"}).mapInArrow(run, "doc_id bigint, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded binary): ``encode``, and the bytes of those ids, in one worker process."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = text_encoder(path, pattern)
        tokens = _token_array(own.ranks.token)
        for batch in batches:
            for part in _ids_of(own, batch):
                yield part.append_column("decoded", _bytes_of(tokens, part.column(1)))

    return pick(docs, **{id_col: "bigint", text_col: "string"}).mapInArrow(run, "doc_id bigint, ids array<int>, decoded binary")


def _bytes_of(tokens: pa.Array, lists: pa.Array) -> pa.Array:
    """The bytes of each id list: the tokens are taken in one go, so those of a list lie in a row."""
    flat = tokens.take(lists.flatten())
    at = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, 8 * flat.offset) if len(flat) else np.zeros(1, np.int64)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = at[np.concatenate([[0], np.cumsum(sizes)])]
    data = flat.buffers()[2] or pa.py_buffer(b"")
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int64)), data]).cast(pa.binary())
    return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.binary())) if lists.null_count else whole


def _token_array(token: dict[int, bytes]) -> pa.Array:
    """The bytes of every id, by id."""
    return pa.array([token.get(k) for k in range(max(token, default=-1) + 1)], pa.large_binary())


def decode(ids: Column, path: str) -> Column:
    """The bytes of an id array; null for null."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with open(path, "rb") as lines:
            token = _token_array({int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)})
        for lists in batches:
            yield _bytes_of(token, lists)

    return run(ids)
