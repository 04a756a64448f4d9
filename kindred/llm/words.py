"""Hashes of the words and word shingles of many texts at once, in numpy over Arrow's text buffers.

Words are the runs between the ASCII white space characters, with A-Z lowered. A word's 64-bit hash is a
polynomial over random byte values, finished by a mixer; a shingle's is a chained mix of its words' hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled in pieces of this size, cut at white space.
CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if 0 not in _powers or len(_powers[0][0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        tables = []
        for base in (_BASE, _UNBASE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[0] = tuple(tables)
    return _powers[0]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def _hash_block(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of one block and their first bytes' positions; breaks: where texts begin."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, unpower = _power_tables(n)
    word = ~_SPACE[raw]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    fresh = breaks[(breaks > 0) & (breaks < n)]
    begin[fresh] = word[fresh]
    starts = np.flatnonzero(begin)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[fresh - 1] = word[fresh - 1]
    ends = np.flatnonzero(last)
    total = np.cumsum(_VALUE[raw] * power[:n], dtype=np.uint64)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    lengths = (ends - starts + 1).astype(np.uint64)
    return mix((total[ends] - before) * unpower[starts] + lengths), starts


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts raw[offsets[i]:offsets[i + 1]], and n + 1 offsets of the texts into them."""
    hashes, starts, at = [], [], 0
    while at < len(raw):
        to = min(at + CHUNK, len(raw))
        if to < len(raw):
            tail = np.flatnonzero(_SPACE[raw[at:to]])
            cut = offsets[np.searchsorted(offsets, to, "right") - 1]
            if len(tail):
                to = max(at + int(tail[-1]) + 1, int(cut))
            elif cut > at:
                to = int(cut)
            else:  # one word longer than a block: it ends at the next white space or text
                after = np.flatnonzero(_SPACE[raw[to:]][: 1 << 26])
                stop = int(offsets[np.searchsorted(offsets, to, "right")]) if to < offsets[-1] else len(raw)
                to = min(to + int(after[0]) if len(after) else len(raw), stop)
        h, s = _hash_block(raw[at:to], offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, to, "right")] - at)
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    places = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(places, offsets, "left")


def shingle_sets(column: pa.Array, width: int):
    """For each text the sorted distinct hashes of its shingles of ``width`` words.

    A text of fewer words counts as one shingle of all its words; one without words has an empty set.
    """
    raw, offsets = text_buffers(column)
    n = len(offsets) - 1
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        words, cuts = word_hashes(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        chained = chain(words, width)
        for i in range(to - at):
            a, b = int(cuts[i]), int(cuts[i + 1])
            if b - a >= width:
                yield np.unique(chained[a : b - width + 1])
            elif b > a:
                yield chain(words[a:b], b - a)[:1] + np.uint64(b - a)
            else:
                yield words[:0]
        at = to


def chain(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words from each place on (places near the end wrap nothing: the result is shorter)."""
    n = len(words) - width + 1
    if n <= 0:
        return words[:0]
    out = words[:n] + np.uint64(width)
    for k in range(1, width):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : n + k])
    return out
