"""Vectorised text kernels: whole batches of texts are cut into words and hashed as arrays, without a Python step per word.

A word's hash is the XXH64 of its bytes. A window's hash is a tree over its words' hashes, a longer sequence's the XXH64 of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from tallymill.llm.xxh64 import xxh64_slices

U64 = np.uint64
#: Bytes of text that one array step works on; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


#: A-Z as a-z.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Separators of words [^\x20\x09-\x0D]+.
SPACES = np.zeros(256, dtype=bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
PUNCTUATION = np.zeros(256, dtype=bool)
PUNCTUATION[:128] = True
for _a, _b in ((48, 58), (97, 123), (65, 91)):
    PUNCTUATION[_a:_b] = False


class Words:
    """The words of a batch of texts: byte bounds in one buffer, and for each text the range of its words."""

    def __init__(self, texts: Sequence[bytes], separators: np.ndarray = SPACES) -> None:
        self.texts = texts
        self.data = b" ".join([*texts, b""])
        self.buf = np.frombuffer(self.data, dtype=np.uint8)
        self.offsets = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offsets[1:])
        word = np.zeros(len(self.buf) + 2, dtype=np.int8)
        word[1:-1] = ~separators[self.buf]
        turn = np.diff(word)
        self.starts, self.ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        #: Words of text i: bounds[i] to bounds[i + 1].
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts), dtype=np.int64), np.diff(self.bounds))

    def hashes(self, fold: bool = False, seed: int = 0) -> np.ndarray:
        """XXH64 of each word. Seeds give independent hashes."""
        return xxh64_slices(self.data.translate(FOLD) if fold else self.data, self.starts, self.ends, seed)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((a * U64(0x9E3779B97F4A7C15)) ^ b)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of width words, a tree over runs of 1, 2, 4, ... words whose every node is mixed, so that no
    pattern of words cancels out; runs that cross a text's end are the caller's to mask."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    run, size, out, done = words, 1, None, 0
    while True:
        if width & size:
            out = run[:n] if out is None else _joined(out, run[done : done + n])
            done += size
        if done == width:
            return mix(out + U64(width))
        run, size = _joined(run[:-size], run[size:]), 2 * size


def sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run of words, of any length: XXH64 over the words' hashes."""
    return xxh64_slices(np.ascontiguousarray(words, dtype="<u8").tobytes(), 8 * np.asarray(starts), 8 * np.asarray(ends), 0)


def same_doc(bounds: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask over the first n - width + 1 words: the run of width words lies in one text."""
    m = max(0, n - width + 1)
    out = np.ones(m, dtype=bool)
    for k in range(1, width):
        ends = bounds[1:-1] - k
        out[ends[(ends >= 0) & (ends < m)]] = False
    return out


def batches(sizes: Sequence[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n + 1
    if at < len(sizes):
        yield at, len(sizes)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count times for each pair."""
    total = int(counts.sum())
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if len(counts) else np.empty(0, dtype=np.int64)
    return first + np.arange(total)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys):
        return np.empty(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])))


def runs(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of each run of equal keys."""
    at = group_starts(sorted_keys)
    return list(zip(at.tolist(), [*at[1:].tolist(), len(sorted_keys)], strict=True)) if len(at) else []


def hit_words(n: int, starts: np.ndarray, widths) -> np.ndarray:
    """Mask of the words that any run (start, width) covers."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + widths, n), -1)
    return np.cumsum(edge[:-1]) > 0
