"""Whole texts cut at places where the byte-level BPE pattern always ends a match, so that parts can be encoded once.

The pattern never lets a match run from a non-space character into white space, so the start of
a run of white space always is a boundary.  Texts with white space other than the space and the
line feed are not cut.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁤　﻿]")


_MARKS = frozenset(".,%&$*#!?;:|")
_TAIL = re.compile(r"(.*[A-Za-zÀ-ɏ])([.,%&$*#!?;:|]+)", re.DOTALL)


def cuttable(text: str) -> bool:
    return not _OTHER_SPACE.search(text)


def single_spaced(text: str) -> bool:
    """True for a text of words with one space or one line feed between them and nothing around."""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[:1] in ("", " ", "\n") or text[-1] in " \n")


def words_of(text: str) -> tuple[str, list[str], str]:
    """A cuttable text as its start, words and trailing white space.

    A word that follows one space stands without it; any other begins with its white space.
    """
    if not single_spaced(text):
        parts = _CHUNK.findall(text)
        first = parts.pop(0) if parts and parts[0][0] not in " \n" else ""
        last = parts.pop() if parts and parts[-1][-1] in " \n" else ""
        return first, [p[1:] if p[0] == " " and p[1] not in " \n" else p for p in parts], last
    words = text.replace("\n", " \n").split(" ")
    return words[0], words[1:], ""


def word_and_marks(chunk: str) -> tuple[str, str]:
    """A chunk cut where a letter meets closing marks, which the pattern never joins; else the chunk and nothing."""
    found = _TAIL.fullmatch(chunk)
    return (found[1], found[2]) if found else (chunk, "")


CACHED_WORDS = 400_000  # twice that many stand in the two caches of a worker
CACHED_MARKS = 10_000
BATCH_CHARS = 4 << 20


class WordCache:
    """Whole texts to bytes of ids; a word met before is looked up.

    ``encode_words`` gets sorted texts that begin with white space and end in a visible
    character; ``encode_text`` gets anything, and every text of which ``whole`` is true.  A full cache becomes the older one, from
    which words still in use come back.  The caches save time and change no result.
    """

    def __init__(self, encode_words: Callable[[list[str]], Iterable[bytes]], encode_text: Callable[[str], bytes], whole: Callable[[str], bool] = lambda text: False):
        self.encode_words, self.encode_text, self.whole = encode_words, encode_text, whole
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _learn(self, new: set[str]) -> None:
        if len(self.marks) > CACHED_MARKS:
            self.marks.clear()
        known, older, cut, plain = self.known, self.older, [], set()
        for word in new:
            if word in older:
                known[word] = older[word]
                continue
            stem, marks = word_and_marks(word) if word[-1] in _MARKS else (word, "")
            if marks:
                cut.append((word, stem, marks))
                if marks not in self.marks:
                    self.marks[marks] = self.encode_text(marks)
            if stem in older:
                known[stem] = older[stem]
            elif stem not in known:
                plain.add(stem)
        words = sorted(plain)
        known.update(zip(words, self.encode_words([w if w[0] in " \n" else " " + w for w in words]), strict=True))
        for word, stem, marks in cut:
            known[word] = known[stem] + self.marks[marks]

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        """Arrow parts the plain texts at their spaces and finds the distinct words; only those are looked up one by one."""
        kinds = [0 if not cuttable(t) or self.whole(t) else 1 if single_spaced(t) else 2 for t in texts]
        plain = pc.split_pattern(pc.replace_substring(pa.array([t for t, k in zip(texts, kinds, strict=True) if k == 1], pa.string()), "\n", " \n"), " ")
        flat, bounds = plain.flatten(), plain.offsets.to_numpy()
        rest = np.ones(len(flat), bool)
        rest[bounds[:-1]] = False
        firsts, counts = iter(flat.take(pa.array(bounds[:-1])).to_pylist()), iter((np.diff(bounds) - 1).tolist())
        others = [words_of(t) for t, k in zip(texts, kinds, strict=True) if k == 2]
        words = pa.concat_arrays([flat.filter(pa.array(rest)), *[pa.array(o[1], pa.string()) for o in others]]).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, distinct))
        new = [k for k, ids in enumerate(found) if ids is None]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        self._learn({distinct[k] for k in new})
        for k in new:
            found[k] = self.known[distinct[k]]
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        at = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1).tolist() if len(ids) else [0]
        data = memoryview(ids.buffers()[2] or b"")
        end, other_end, rows = 0, int(rest.sum()), iter(others)
        for text, kind in zip(texts, kinds, strict=True):
            if not kind:
                yield self.encode_text(text)
                continue
            if kind == 1:
                first, last, begin = next(firsts), "", end
                stop = end = begin + next(counts)
            else:
                first, own, last = next(rows)
                begin = other_end
                stop = other_end = begin + len(own)
            yield (self.encode_text(first) if first else b"") + data[at[begin] : at[stop]] + (self.encode_text(last) if last else b"")

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order; about ``BATCH_CHARS`` characters, or one text, are in work at a time."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= BATCH_CHARS:
                yield from self._encode(held)
                held, size = [], 0
        yield from self._encode(held)
