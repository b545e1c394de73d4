"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a longest run of bytes of a given class.  Bytes of 0x80 and above belong to
characters outside ASCII, and both classes used here take or leave those as a
whole, so byte classes equal the character classes of the contracts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP = 1 << 20  # bytes of text that are worked on together (one longer text is a group of its own)

_ALL = np.arange(256)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] after A-Z are made a-z
ALNUM = (_ALL >= 0x80) | ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A))
#: [^\x20\x09-\x0D]
NOT_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _GRAM = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2 ** 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, 2 * GROUP), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD1342543DE82EF95)
    return h ^ (h >> np.uint64(29))


class Words(NamedTuple):
    """Words of a group of texts, in order."""
    first: int           # number of the group's first text in its batch
    texts: int           # how many texts
    doc: np.ndarray      # each word's text, from 0 in the group
    hash: np.ndarray     # 64-bit hash of each word
    start: np.ndarray    # byte offsets in ``data``
    end: np.ndarray
    data: np.ndarray     # the group's bytes (A-Z made a-z if asked for)
    bounds: np.ndarray   # where each text begins in ``data``, and the end


def _pieces(data: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cut a long text into pieces of about GROUP bytes that end beside a non-word byte."""
    at, n = 0, len(data)
    while at < n:
        to = at + GROUP
        while to < n:
            stop = np.flatnonzero(~is_word[data[to:to + GROUP]])
            if len(stop):
                to += int(stop[0])
                break
            to += GROUP
        yield at, min(to, n)
        at = min(to, n)


def _scan(data: np.ndarray, begins: np.ndarray, is_word: np.ndarray):
    """start, end, hash of the words; ``begins``: offsets at which a word can't be continued."""
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[begins] = True
    edge[0] = edge[-1] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    h = (total[end] - total[start]) * _power(_BASE_INV, len(data))[start]
    return start, end, mixed(h)


def groups(texts: pa.Array, is_word: np.ndarray, lower: bool) -> Iterator[Words]:
    """The words of a string column (null: no words), group by group."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    body = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + GROUP, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        data = body[offsets[first]:offsets[last]]
        data = LOWER[data] if lower else data
        bounds = (offsets[first:last + 1] - offsets[first]).astype(np.int64)
        if len(data) <= 2 * GROUP:
            start, end, h = _scan(data, bounds, is_word)
        else:  # one long text
            parts = [(a, *_scan(data[a:b], np.zeros(1, np.int64), is_word)) for a, b in _pieces(data, is_word)]
            start = np.concatenate([a + s for a, s, _, _ in parts])
            end = np.concatenate([a + e for a, _, e, _ in parts])
            h = np.concatenate([x for _, _, _, x in parts])
        doc = np.searchsorted(bounds[:-1], start, "right") - 1
        yield Words(first, last - first, doc, h, start, end, data, bounds)
        first = last


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _GRAM + h[j:j + n]
    return mixed(out)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in one of the ranges."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def lists(values: pa.Array, owner: np.ndarray, n: int) -> pa.ListArray:
    """A list column of n rows; ``owner``: ascending row number of each value."""
    offsets = np.searchsorted(owner, np.arange(n + 1), "left").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
