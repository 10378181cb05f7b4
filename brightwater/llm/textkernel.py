"""Vectorised word and n-gram hashing over Arrow string buffers.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D.  The
separators are ASCII, so UTF-8 text is handled as raw bytes, unchanged.  Every
hash here is a fixed function of the bytes: the same on every executor and in
every run, which makes recomputing a lost partition safe.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: ASCII letters and digits, and all bytes of other characters.
ALNUM = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
#: Words longer than this are hashed one by one.
_LONG_WORD = 256
#: Odd factors of the two hashes of a word, and of the two sides when hashes are joined.
_FACTORS = ((_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)), (_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def trim() -> None:
    """Give this process's free memory back to the machine."""
    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        release(0)


def lean(work: Callable) -> Callable:
    """work over batches, leaving no free memory in its worker: workers live on between tasks."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def lean_group(work: Callable) -> Callable:
    """As lean, for a function of a key and one group, or two cogrouped ones."""

    def one(key, table):
        try:
            return work(key, table)
        finally:
            trim()

    def two(key, left, right):
        try:
            return work(key, left, right)
        finally:
            trim()

    run = two if work.__code__.co_argcount == 3 else one
    return functools.wraps(work, assigned=("__module__", "__name__", "__qualname__", "__doc__"))(run)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


class Words:
    """Words of several texts: byte spans, text numbers, 64-bit hashes, a second hash and exact numbers on demand."""

    __slots__ = ("start", "end", "doc", "first", "_data", "_hash")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, in_word: np.ndarray = _IS_WORD):
        n_docs = len(offsets) - 1
        word = in_word[data]
        edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        before = np.empty_like(word)
        after = np.empty_like(word)
        if len(word):
            before[0] = False
            before[1:] = word[:-1]
            before[edge] = False
            after[-1] = False
            after[:-1] = word[1:]
            after[edge - 1] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        #: Number of the first word of each text, and the number of words at the end.
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(n_docs), np.diff(self.first))
        self._data = _LOWER[data] if lower else data
        self._hash: np.ndarray | None = None

    @property
    def hash(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if self._hash is None:
            self._hash = _hash_spans(self._data, self.start, self.end, 0)
        return self._hash

    def second(self) -> np.ndarray:
        """A second 64-bit hash of each word, made from its bytes."""
        return _hash_spans(self._data, self.start, self.end, 1)

    def numbers(self, *others: Words) -> list[np.ndarray]:
        """Numbers of the words of this and the others: equal if and only if the words are."""
        all_of = (self, *others)
        sizes = np.concatenate([w.end - w.start for w in all_of])
        raw = np.concatenate([_gather(w._data, w.start, w.end) for w in all_of])
        offsets = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        return np.split(codes, np.cumsum([len(w.start) for w in all_of])[:-1])

    def starts(self, n: int) -> np.ndarray:
        """Numbers of the words at which a run of n words of one text begins."""
        if len(self.start) < n:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])

    def grams(self, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words within one text, and their first words' numbers; seed 1: from the second hash."""
        at = self.starts(n)
        if not len(at):
            return np.empty(0, _U), at
        return gram_hashes(self.second() if seed else self.hash, n, seed)[at], at


def _runs(items: np.ndarray, n: int, join) -> np.ndarray:
    """join over items[i : i + n] for each i, by runs of 1, 2, 4 and so on items."""
    power, size, out, done = items, 1, None, 0
    while True:
        if n & size:
            if out is None:
                out, done = power, size
            else:
                m = len(items) - done - size + 1
                out, done = join(out[:m], power[done : done + m]), done + size
        size *= 2
        if size > n:
            return out
        power = join(power[: len(power) - size // 2], power[size // 2 :])


def gram_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of words[i : i + n] for each i; order counts, and each step mixes."""
    _, left, right = _FACTORS[seed]
    return mix(_runs(words, n, lambda a, b: mix(a * left + b * right)) + _U(n))


def exact_runs(numbers: np.ndarray, n: int) -> np.ndarray:
    """Numbers of numbers[i : i + n] for each i: equal if and only if the runs are."""

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int64)

    return _runs(numbers, n, join)


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of the spans end to end."""
    if not len(start):
        return np.empty(0, np.uint8)
    mark = np.zeros(len(data) + 1, np.int8)
    mark[start] += 1
    mark[end] -= 1
    return data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]


def _hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
    """64-bit hashes of the spans: eight bytes at a time, each step multiplied and mixed; long ones by BLAKE2."""
    size = end - start
    factor, left, _ = _FACTORS[which]
    out = mix(size.astype(_U) * left + factor)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    active, at, left_over = np.arange(len(start)), start, size
    if len(size) and int(size.max()) > _LONG_WORD:
        long = np.flatnonzero(size > _LONG_WORD)
        for i in long.tolist():
            digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=16).digest()
            out[i] = int.from_bytes(digest[8 * which : 8 * which + 8], "little")
        active = np.flatnonzero(size <= _LONG_WORD)
        at, left_over = start[active], size[active]
    while len(active):
        chunk = eights[at]
        short = left_over < 8
        chunk[short] &= (_U(1) << (left_over[short].astype(_U) * _U(8))) - _U(1)
        out[active] = mix((out[active] ^ chunk) * factor + left)
        more = left_over > 8
        active, at, left_over = active[more], at[more] + 8, left_over[more] - 8
    return out


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text each; a longer text stands alone."""
    _, offsets = buffers(column)
    at, n = 0, len(column)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)
