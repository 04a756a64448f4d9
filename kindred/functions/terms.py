"""Terms of texts as 64-bit hashes, counted in numpy one Arrow batch at a time.

A term is a token key ``type:value`` or an n-gram of keys. Its number is the first 8 bytes of the key's BLAKE2b, n-grams mix those of their
keys; among ten million terms two share a number with a chance of 3 in a million.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from kindred.functions.tokenizer import KEYWORDS, find_tokens, split_identifier, tokenize

#: Entries after which a worker's memory of tokens, or the terms counted in a task so far, are let go or passed on.
MEMO, HELD = 120_000, 2_000_000
#: Texts of a batch are handled so many characters at a time.
CHARS = 1 << 21

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def xxhash64(keys: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = (np.uint64(42 + 8) + _P5) ^ (_turn(keys.view(np.uint64) * _P2, 31) * _P1)
        h = _turn(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))).view(np.int64)


#: What a name begins with.
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$")


class _Memo(dict):
    """Token as found in the text: the numbers of the keys that ``tokenize`` makes of it."""

    def __init__(self, language: str):
        self.language = language

    def __missing__(self, value: str) -> tuple[int, ...]:
        if value[0] in _NAME and value not in KEYWORDS[self.language]:  # most tokens are names, which need no second scan
            found = [(p.lower(), "identifier") for p in split_identifier(value) if len(p) > 1]
        else:
            found = tokenize(value, self.language)
        out = tuple(int.from_bytes(hashlib.blake2b(f"{t}:{v}".encode(), digest_size=8).digest(), "little", signed=True) for v, t in found)
        if len(self) >= MEMO:
            self.clear()
        self[value] = out
        return out


_memos: dict[str, _Memo] = {}
#: The projection's rows in a worker, by (seed, slots, dimension).
dense_rows: dict = {}


def spare() -> None:
    """Let go what earlier passes left in this worker, which Spark reuses, and give freed memory back."""
    dense_rows.clear()
    _memos.clear()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def gaussian(seed: int, slots: int, dimension: int) -> np.ndarray:
    """The projection's rows, made once in a worker, a part at a time."""
    if dense_rows.get("key") != (seed, slots, dimension):
        draw, rows = np.random.Generator(np.random.PCG64(seed)), np.empty((slots, dimension), np.float32)
        for k in range(0, slots, 1024):
            rows[k : k + 1024] = draw.standard_normal((min(1024, slots - k), dimension))
        dense_rows.update(key=(seed, slots, dimension), rows=rows)
    return dense_rows["rows"]


def text_keys(text: str | None, language: str | None) -> np.ndarray:
    """The numbers of a text's keys, in order."""
    language = language if language in KEYWORDS else "typescript"
    memo = _memos.setdefault(language, _Memo(language))
    return np.fromiter(chain.from_iterable(map(memo.__getitem__, find_tokens(text or ""))), np.int64)


def key_terms(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, their counts) of a text's keys, terms ascending: the keys and their n-grams."""
    terms = keys
    if n > 1 and len(keys) >= n:
        grams = keys[: len(keys) - n + 1].view(np.uint64)
        with np.errstate(over="ignore"):
            for k in range(1, n):
                grams = xxhash64(_turn(grams, 23) * _P3 + keys[k : len(keys) - n + 1 + k].view(np.uint64)).view(np.uint64)
        terms = np.concatenate([keys, grams.view(np.int64)])
    return np.unique(terms, return_counts=True)


def text_terms(text: str | None, language: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(terms, their counts) of a text, terms ascending: its keys and their n-grams."""
    return key_terms(text_keys(text, language), n)


#: Columns of ``coded`` beside the ids.
CODED = "copies array<long>, digests array<binary>, lens binary, keys binary, codes binary"


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many texts each, of (block_id, content, language, copies): the texts' keys, told by their places among the different ones, and a digest of each text's keys; texts without keys left out."""
    spare()
    kept, held, chars = [], [], 0

    def row() -> pa.RecordBatch:
        keys, codes = np.unique(np.concatenate(held), return_inverse=True)
        ids, copies = (pa.concat_arrays([k[c] for k in kept]) for c in (0, 1))
        digests = pa.array([hashlib.blake2b(h.tobytes(), digest_size=16).digest() for h in held], pa.binary())
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, copies, digests)]
        packed = [np.array([len(h) for h in held], np.int32).tobytes(), keys.tobytes(), pa.compress(codes.astype(np.int32).tobytes(), "zstd", asbytes=True)]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in packed)], ["ids", "copies", "digests", "lens", "keys", "codes"])

    for batch in batches:
        for k, (text, language) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            text = text.as_py()
            keys = text_keys(text, language.as_py())
            if len(keys):
                kept.append((batch.column(0).slice(k, 1), batch.column(3).slice(k, 1)))
                held.append(keys)
            chars += len(text or "")
            if chars >= CHARS and held:
                out = row()
                kept, held, chars = [], [], 0
                yield out
    if held:
        yield row()


def coded_terms(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """(ids, copies, terms of each) of rows (ids, copies, lens, keys, codes) of ``coded``."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, copies, lens, keys, codes = (batch.column(c)[k] for c in range(5))
            ends = np.cumsum(np.frombuffer(lens.as_buffer(), np.int32), dtype=np.int64)
            codes = np.frombuffer(pa.decompress(codes.as_buffer(), int(ends[-1]) * 4, "zstd"), np.int32)
            every = np.frombuffer(keys.as_buffer(), np.int64)[codes]
            yield ids.values, copies.values.to_numpy(), [key_terms(x, n) for x in np.split(every, ends[:-1])]


def batch_terms(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list[tuple[np.ndarray, np.ndarray]]]]:
    """(ids, terms of each) of (block_id, content, language), texts without terms left out."""
    for batch in batches:
        at, found, chars = [], [], 0
        for k, (text, language) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            text = text.as_py()
            terms = text_terms(text, language.as_py(), n)
            if len(terms[0]):
                at.append(k)
                found.append(terms)
            chars += len(text or "")
            if chars >= CHARS and found:
                yield batch.column(0).take(pa.array(at)), found
                at, found, chars = [], [], 0
        if found:
            yield batch.column(0).take(pa.array(at)), found


def totals(found: Iterator[tuple[np.ndarray, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """(term, in how many texts) of (copies, terms) of texts that come so often, summed as far as memory allows."""
    spare()
    held: dict[int, list[np.ndarray]] = {}
    size = 0

    def summed() -> Iterator[pa.RecordBatch]:
        for often, own in held.items():
            terms, counts = np.unique(np.concatenate(own), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms), pa.array(counts * often)], ["term", "df"])

    for copies, terms in found:
        for often, t in zip(copies.tolist(), terms, strict=True):
            held.setdefault(often, []).append(t)
            size += len(t)
        if size >= HELD:
            yield from summed()
            held.clear()
            size = 0
    yield from summed()


def projected(terms: np.ndarray, counts: np.ndarray, known: np.ndarray, often: np.ndarray, n_docs: int, min_df: int, max_df: int | None, rows: np.ndarray) -> np.ndarray:
    """Unit vector of a text: each term adds its weight times the row of its slot. Terms that aren't known occur in this text alone."""
    df = np.ones(len(terms))
    if len(known):
        at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
        df = np.where(known[at] == terms, often[at], 1.0)
    weight = (1 + np.log(counts)) * (np.log((n_docs + 1.0) / (df + 1)) + 1)
    kept = (weight > 0) & (df >= min_df)
    if max_df is not None:
        kept &= df <= max_df
    slots, weight = np.mod(xxhash64(terms[kept]), len(rows)), weight[kept]
    v = np.zeros(rows.shape[1])
    for k in range(0, len(slots), 256):  # rows that stay in the cache
        v += weight[k : k + 256].astype(np.float32) @ rows[slots[k : k + 256]]
    size = np.linalg.norm(v)
    return v / size if size else v
