"""Hashes of all words of many texts at once, as array operations on their bytes.

A word is a run of bytes other than ASCII white space, with A-Z lower-cased. Its hash is a polynomial over a value for each
byte, modulo 2 ** 64, then mixed: the difference of two running sums gives it without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes that are worked on at a time (more only where one word is longer), and bytes of texts in a lot.
CHUNK, LOT = 1 << 19, 2 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = np.random.default_rng(2024).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, ..., base ** (n - 1) modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        out = np.full(max(n, CHUNK + 1), base, np.uint64)
        out[0] = 1
        out = np.multiply.accumulate(out)
        if n > CHUNK + 1:
            return out
        _powers[base] = out
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit numbers whose bits all depend on all bits of the given ones."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def joined(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of ``n`` hashes that follow each other, at its first one's place."""
    m = max(0, len(h) - n + 1)
    out = h[:m].copy()
    for k in range(1, n):
        out = out * np.uint64(_BASE) + h[k : k + m]
    return mixed(out)


def _hashes(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of ``data``; at the ascending places ``breaks`` words end."""
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    at = breaks[(breaks > 0) & (breaks < len(data))]
    first[at], last[at - 1] = word[at], word[at - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _power(_BASE, len(data)), out=sums[1:])
    return mixed((sums[e] - sums[s]) * _power(_INVERSE, len(data))[s] + (e - s).astype(np.uint64)), s


def parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and where each begins and the last one ends. Null texts are empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (unsigned, 64 bits) of the words of all whole texts, and where those of each text begin and the last's end."""
    data, offsets = parts(texts)
    found, firsts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + CHUNK)
        while end < len(data):  # a chunk ends with white space, or with a text
            space = np.flatnonzero(_SPACE[data[at:end]])
            cut = offsets[np.searchsorted(offsets, end, "right") - 1]
            end_of = max(at + space[-1] + 1 if len(space) else at, cut)
            if end_of > at:
                end = int(end_of)
                break
            end = min(len(data), end + CHUNK)
        h, s = _hashes(data[at:end], offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at)
        found.append(h)
        firsts.append(s + at)
        at = end
    return np.concatenate(found), np.searchsorted(np.concatenate(firsts), offsets)


def lots(batch: pa.RecordBatch, column: int, size: int = LOT) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch, of about so many bytes of the column's texts (a longer text is alone)."""
    _, offsets = parts(batch.column(column))
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1 - at)
        yield batch.slice(at, n)
        at += n
