"""Vectorised text kernels (numpy over Arrow buffers; no Spark imports).

A column of texts is seen as one byte buffer with document offsets. Null texts
count as empty. Words are maximal runs of bytes outside the ASCII white space
``\\x20\\x09-\\x0D``; because every separator is a single ASCII byte, bytes and
code points give the same words.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_ODD = U64(0x9E3779B97F4A7C15)
_LONG = 48  # longer words are hashed one by one
_KEPT = 1 << 21

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
LOWER_BYTES = LOWER.tobytes()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix64 finaliser: a bijection of uint64 that spreads every bit."""
    with np.errstate(over="ignore"):
        z = x + U64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> U64(30))) * _M1
        z = (z ^ (z >> U64(27))) * _M2
        return z ^ (z >> U64(31))


_BYTE = mix(np.arange(256, dtype=U64), 7)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n; up to ``_KEPT`` of them are kept for the next call."""
    if "p" in _powers and len(_powers["p"]) >= n:
        return _powers["p"][:n], _powers["i"][:n]
    size, made = max(n, 1 << 16), {}
    for key, base in (("p", int(_ODD)), ("i", pow(int(_ODD), -1, 1 << 64))):
        steps = np.full(size, U64(base))
        steps[0] = 1
        made[key] = np.multiply.accumulate(steps)
    if size <= _KEPT:
        _powers.update(made)
    return made["p"][:n], made["i"][:n]


def release() -> None:
    """Give memory that a task no longer uses back to the machine: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the n + 1 offsets of its documents."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column if pa.types.is_large_binary(column.type) else column.cast(pa.large_string()), "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each holds about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        piece = np.cumsum(lengths.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


class Words:
    """Words of a buffer: byte ``starts`` and ``ends``, ``counts`` by document, ``doc`` index by word."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray) -> None:
        word = ~SPACE[buf]
        first = np.zeros(len(buf) + 1, bool)
        first[offs] = True
        before, after = np.empty_like(word), np.empty_like(word)
        if len(buf):
            before[0], before[1:] = False, word[:-1]
            after[-1], after[:-1] = False, word[1:]
        self.buf = buf
        self.starts = np.flatnonzero(word & (~before | first[:-1]))
        self.ends = np.flatnonzero(word & (~after | first[1:])) + 1
        self.counts = np.diff(np.searchsorted(self.starts, offs))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, the same on every machine."""
        length = self.ends - self.starts
        out = mix(length.astype(U64), 1)
        with np.errstate(over="ignore"):
            live = np.flatnonzero(length <= _LONG)
            at = self.starts[live]
            acc = out[live]
            j, left = 0, length[live]
            while len(live):
                acc = (acc ^ _BYTE[self.buf[at + j]]) * _ODD
                acc ^= acc >> U64(29)
                j += 1
                done = left <= j
                if done.any():
                    out[live[done]] = acc[done]
                    more = ~done
                    live, at, acc, left = live[more], at[more], acc[more], left[more]
        for i in np.flatnonzero(length > _LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.buf[self.starts[i] : self.ends[i]].tobytes())
        return mix(out, 2)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries of h (len(h) - size + 1 of them)."""
    n = len(h)
    if n < size:
        return np.zeros(0, U64)
    p, inverse = powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, U64), np.cumsum(h * p[:n], dtype=U64)))
        return mix((sums[size:] - sums[:-size]) * inverse[: n - size + 1], 3)


def window_starts(first: np.ndarray, size: int, total: int) -> np.ndarray:
    """True for each start of a run of ``size`` entries that stays inside one document."""
    ok = np.ones(max(0, total - size + 1), bool)
    for end in first[1:-1]:
        ok[max(0, end - size + 1) : end] = False
    return ok


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of ``size`` consecutive entries."""
    span, out = 1, x
    while span * 2 <= size:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = size - span
    return np.minimum(out[:-rest], out[rest:]) if rest else out
