"""Periodic runs of words: Lyndon arrays by Baier's grouping, Lyndon roots extended into runs.

The first phase of Baier's suffix sorter groups suffixes by their longest Lyndon prefix.  Groups
start as equal words and are taken in descending order.  Each member of the group in hand points
to the nearest suffix before it in a lower group; a suffix that gets k pointers has its prefix
prolonged by k times the group's prefix and goes, with those that got as many and were in the same
group, to a new group just above its old one.  When a group is taken, its members' prefix is their
longest Lyndon prefix: the Lyndon array comes directly, without a suffix array.

Done under an order of the words and under the reverse one, every run has a Lyndon root that is
the longest Lyndon word at its start under one of the two.  Each candidate root is extended left
and right by longest common extensions, looked up in names of the power-of-two windows (equal
windows have equal names), all candidates of a piece at a time.  Extensions are maximal and Lyndon
words have no border, so the period found is the smallest.

Only places that a run may hold are grouped: inside a run of period q each word recurs q places
on or back, so a stretch is cut at words that do not recur within a ``powers``-th of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.words import joined, lists, slices, split, starts_of

LEAST_LENGTH = 6
POWERS = 4


def lyndon_array(s: list[int]) -> list[int]:
    """The length of the longest Lyndon word that starts at each place, by grouping."""
    n = len(s)
    symbols = sorted(set(s))
    number = {c: k for k, c in enumerate(symbols)}
    members: list[list[int]] = [[] for _ in symbols]
    for i, c in enumerate(s):
        members[number[c]].append(i)
    group = [number[c] for c in s]
    size, below, above = [1] * len(symbols), list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
    found, up, taken = [0] * n, list(range(-1, n - 1)), [False] * n
    g = len(symbols) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        length = size[g]
        for i in own:
            taken[i] = True
            found[i] = length
        targets: list[int] = []
        hits: list[int] = []
        for i in own:
            j = i - 1
            if j >= 0 and taken[j]:
                while j >= 0 and taken[j]:
                    j = up[j]
                up[i - 1] = j
            up[i] = j
            if j >= 0:
                if targets and targets[-1] == j:
                    hits[-1] += 1
                else:
                    targets.append(j)
                    hits.append(1)
        if targets:
            parts: dict[tuple[int, int], list[int]] = {}
            for j, k in zip(targets, hits, strict=True):
                parts.setdefault((-k, group[j]), []).append(j)
            for k, old in sorted(parts):
                part, new, over = parts[k, old], len(size), above[old]
                for j in part:
                    group[j] = new
                members.append(part)
                size.append(size[old] - k * length)
                below.append(old)
                above.append(over)
                above[old] = new
                if over >= 0:
                    below[over] = new
        members[g] = []
        g = below[g]
    return found


def _stretches(ids: np.ndarray, starts: np.ndarray, least: int, powers: int) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the stretches that hold all runs of the texts whose words lie end to end."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    onward = np.full(n, n, np.int64)
    onward[order[:-1][same]] = (order[1:] - order[:-1])[same]
    back = np.full(n, n, np.int64)
    back[order[1:][same]] = (order[1:] - order[:-1])[same]
    begins, ends = starts[:-1], starts[1:]
    left = cuts = 0
    while True:
        keep = ends - begins >= least
        begins, ends = begins[keep], ends[keep]
        sizes = ends - begins
        total = int(sizes.sum())
        if not total or cuts and total > 0.98 * left:  # nearly all of them stay: what is left is grouped
            return begins, ends
        left, cuts = total, cuts + 1
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.arange(total) + np.repeat(begins - first, sizes)
        most, lo, hi = np.repeat(sizes // powers, sizes), np.repeat(begins, sizes), np.repeat(ends, sizes)
        to, fro = onward[at], back[at]
        good = ((to <= most) & (at + to < hi)) | ((fro <= most) & (at - fro >= lo))
        edge = np.zeros(total, bool)
        edge[first] = True
        opens = good & (edge | ~np.concatenate([[False], good[:-1]]))
        closes = good & (np.concatenate([edge[1:], [True]]) | ~np.concatenate([good[1:], [False]]))
        begins, ends = at[opens], at[closes] + 1


class _Extensions:
    """Longest common extensions over several stretches laid end to end with a unique code after each."""

    def __init__(self, codes: np.ndarray, longest: int):
        self.names = [np.unique(codes, return_inverse=True)[1].astype(np.int64)]
        while 2 << (len(self.names) - 1) <= longest:
            last, w = self.names[-1], 1 << (len(self.names) - 1)
            if len(last) <= w:
                break
            pairs = last[:-w] * (len(codes) + 1) + last[w:]
            values, named = np.unique(pairs, return_inverse=True)
            if len(values) == len(pairs):  # no two windows of this length are equal
                break
            self.names.append(named.astype(np.int64))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            while True:  # the highest level may repeat
                there = b + out < len(names)
                same = there.copy()
                same[there] = names[(a + out)[there]] == names[(b + out)[there]]
                out += same * (1 << k)
                if k < len(self.names) - 1 or not same.any():
                    break
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many codes before ``a`` equal those before ``b``; a <= b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            names, w = self.names[k], 1 << k
            while True:
                there = a - out - w >= 0
                same = there.copy()
                same[there] = names[(a - out - w)[there]] == names[(b - out - w)[there]]
                out += same * w
                if k < len(self.names) - 1 or not same.any():
                    break
        return out


def runs_of(ids: np.ndarray, starts: np.ndarray, least: int = LEAST_LENGTH, powers: int = POWERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``least`` words and ``powers`` periods, by start, then period.

    ``ids`` are the words of several texts end to end, ``starts`` where each begins; starts are places in ``ids``.
    """
    begins, ends = _stretches(ids, starts, least, powers)
    none = np.empty(0, np.int64)
    if not len(begins):
        return none, none, none
    sizes = ends - begins
    shift = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.empty(shift[-1], np.int64)
    roots: list[tuple[np.ndarray, np.ndarray]] = []
    top = int(ids.max()) + 1
    for k, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
        own = ids[begin:end]
        at = int(shift[k])
        codes[at : at + len(own)] = own
        codes[at + len(own)] = top + k
        upwards = own.tolist()
        for found in (lyndon_array(upwards), lyndon_array([-c for c in upwards])):
            period = np.array(found, np.int64)
            place = np.flatnonzero((period <= len(own) // powers) & (np.arange(len(own)) + period < len(own)))
            period = period[place]
            same = own[place] == own[place + period]
            roots.append((place[same] + at, period[same]))
    place, period = (np.concatenate(x) for x in zip(*roots, strict=True))
    within = _Extensions(codes, int(sizes.max()))
    right = within.forward(place, place + period)
    left = within.backward(place, place + period)
    length = left + right + period
    long = length >= np.maximum(least, powers * period)
    start = place - left
    key, once = np.unique(np.stack([start[long], period[long]]), axis=1, return_index=True)
    stretch = np.searchsorted(shift, key[0], side="right") - 1
    return key[0] - shift[stretch] + begins[stretch], length[long][once], key[1]


def _finder(least: int, powers: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            words, counts = split(piece.column("text"))
            starts = starts_of(counts)
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64) if len(words) else np.empty(0, np.int64)
            start, length, period = runs_of(ids, starts, least, powers)
            owner = np.searchsorted(starts, start, side="right") - 1
            change = np.zeros(len(ids) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + length, -1)
            keep = np.cumsum(change)[:-1] == 0
            found = lists(owner, len(counts), ("start", start - starts[owner]), ("length", length), ("period", period))
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(counts), found, joined(words, starts, keep)],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LENGTH, powers: int = POWERS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row, from its whole text.

    ``runs`` holds (start, length, period) of every maximal stretch with smallest period q and at
    least max(``least``, ``powers`` * q) words, by start, then period; ``collapsed`` is the text
    without the words that a run holds after its first q, joined by one space.  Null and wordless
    texts have no words, no runs and an empty collapsed text.  Repeated rows and null ids come out
    as they went in; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_finder(least, powers), "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
