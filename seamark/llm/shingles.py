"""Word shingles of many texts at once, as 64-bit hashes in numpy.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]`` after lower-casing A-Z. All
arithmetic is modulo 2**64, so the same text gives the same hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A random value for each byte after lower-casing; white space counts as nothing.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[LOWER]
BYTE[SPACE] = 0
#: Odd, so that powers never vanish.
BASE = np.uint64(0xD6E8FEB86659FD93)
STEPS = mix(np.arange(11, 43, dtype=np.uint64)) | np.uint64(1)


def word_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE, head: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, or of its first ``head`` bytes, and the number of words of every document.

    ``starts`` and ``ends`` are the documents' places in ``data``, one after another;
    ``space`` says which bytes stand between words.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    word = ~space[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = starts[(starts < n) & (starts < ends)]
    first[edges] = word[edges]
    at = np.flatnonzero(first)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    place = np.arange(n)
    place -= np.maximum.accumulate(np.where(first, place, 0))
    longest = int(place.max()) + 1
    power = np.cumprod(np.full(longest, BASE, np.uint64))
    counted = word if head is None else word & (place < head)
    hashes = mix(np.add.reduceat(np.where(counted, BYTE[data] * power[place], np.uint64(0)), at))
    return hashes, np.searchsorted(at, ends) - np.searchsorted(at, starts)


def text_chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts, ends) of runs of rows that hold about ``CHUNK_BYTES``, or one longer text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        own = offsets[row : last + 1] - offsets[row]
        yield row, data[offsets[row] : offsets[last]], own[:-1], own[1:]
        row = last


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles.

    A text of fewer words has its whole sequence as one; one without words, or
    null, has none.
    """
    for _, data, starts, ends in text_chunks(texts):
        words, counts = word_hashes(data, starts, ends)
        edge = np.concatenate([[0], np.cumsum(counts)])
        runs = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            runs += words[k : k + len(runs)] * STEPS[k]
        runs = mix(runs)
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            if hi - lo >= width:
                yield np.unique(runs[lo : hi - width + 1])
            elif hi > lo:
                own = words[lo:hi] * STEPS[: hi - lo]
                yield mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(hi - lo))
            else:
                yield np.empty(0, np.uint64)
