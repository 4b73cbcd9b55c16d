"""Word shingles of Arrow text batches as sorted sets of 64-bit hashes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@dataclass
class Sets:
    """``hashes`` holds the sets one after another, each sorted; ``sizes`` their sizes."""

    hashes: np.ndarray
    sizes: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)

    def __getitem__(self, i: int) -> np.ndarray:
        end = int(self.ends[i])
        return self.hashes[end - int(self.sizes[i]) : end]


#: What a byte becomes in lower case, and whether it separates words.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of all texts, one after another, and where each starts and ends; nothing for a null one."""
    filled = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = filled.buffers()
    ends = np.frombuffer(offsets, np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.empty(0, np.uint8)
    return raw, ends[:-1] - ends[0], ends[1:] - ends[0]


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, in order, and the number of words of each text."""
    inside = ~_WHITE[raw]
    some = starts < ends
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A text's words end with it.
    first[starts[some]] = inside[starts[some]]
    last[ends[some] - 1] = inside[ends[some] - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
    padded = np.concatenate([_LOWER[raw], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))
    # Words are read eight bytes at a time; a round goes on with those that are longer.
    hashes = mix((end - begin).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    at, left, which = begin, end - begin, slice(None)
    while len(at):
        unused = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        hashes[which] = mix(hashes[which] * _U(0xD1342543DE82EF95) ^ (eight[at] << unused))
        longer = np.flatnonzero(left > 8)
        at, left = at[longer] + 8, left[longer] - 8
        which = longer if isinstance(which, slice) else which[longer]
    return hashes, counts


def shingle_sets(texts: pa.Array) -> Sets:
    """The distinct five-word shingles of each text, A-Z in lower case.

    A text of fewer words has its whole sequence as its only shingle; one without
    words, and a null one, has none.
    """
    word, lengths = _word_hashes(*_bytes_of(texts))
    first = np.cumsum(lengths) - lengths
    # A whole shingle starts wherever four more words of the same text follow.
    mixed = mix(word)
    whole = np.zeros(len(word), np.uint64)
    most = max(len(word) - WIDTH + 1, 0)
    for k in range(WIDTH):
        whole[:most] = whole[:most] * _U(0x9E3779B97F4A7C15) + mixed[k : k + most]
    whole = mix(whole)
    kept = np.arange(len(word)) < np.repeat(first + lengths - WIDTH + 1, lengths)
    for n in range(1, WIDTH):
        start = first[lengths == n]
        value = np.full(len(start), n, np.uint64)
        for k in range(n):
            value = mix(value) ^ word[start + k]
        whole[start], kept[start] = mix(value), True
    hashes = whole[kept]
    places = np.where(lengths < WIDTH, np.minimum(lengths, 1), lengths - WIDTH + 1)
    ends = np.cumsum(places)
    starts = ends - places
    for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
        hashes[start:end].sort()
    distinct = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
    distinct[starts[starts < ends]] = True
    before = np.concatenate([[0], np.cumsum(distinct)])
    return Sets(hashes[distinct], before[ends] - before[starts])
