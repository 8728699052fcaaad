"""What the Arrow kernels share: bounded slices of batches, words and hashes as numpy arrays.

A word is a maximal run of ASCII letters and digits and of characters beyond
ASCII, compared in lower case. Null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a kernel takes at once; a longer text is taken alone.
SLICE_BYTES = 1_000_000

U = np.uint64


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel, after whose task the worker gives back the memory that it holds in reserve, as workers outlive tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def release() -> None:
    pa.default_memory_pool().release_unused()
    own = ctypes.CDLL(None)
    if hasattr(own, "malloc_trim"):
        own.malloc_trim(0)


_K = 0x9E3779B97F4A7C15
_K_INVERSE = pow(_K, -1, 1 << 64)


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by bytes of text, so that what a kernel allocates is bounded."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); works on a copy."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int, k: int) -> np.ndarray:
    p, done = np.ones(n + 1, U), 1
    while done <= n:  # the next as many as there are
        more = min(done, n + 1 - done)
        np.multiply(p[:more], U(pow(k, done, 1 << 64)), out=p[done : done + more])
        done += more
    return p


def _tables() -> tuple[np.ndarray, np.ndarray]:
    word = np.zeros(256, bool)
    for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
        word[c] = True
    word[128:] = True
    lower = np.arange(256)
    lower[65:91] += 32
    return word, mix(lower.astype(U) + U(0x1234567))


def in_words(data: np.ndarray) -> np.ndarray:
    """Which bytes words are made of, as in _tables(), but without a look-up for each."""
    return ((data | np.uint8(32)) - np.uint8(97) < 26) | (data - np.uint8(48) < 10) | (data > 127)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offset of each row in them."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


class Words:
    """The words of some texts: byte spans, row of each, 64-bit hash of the lower-case form; first[i]:first[i + 1] are row i's."""

    def __init__(self, column: pa.Array, lower: bool = True) -> None:
        value = _tables()[1]
        self.data, self.at = raw(pc.utf8_lower(column.cast(pa.large_string())) if lower else column)
        n = len(self.data)
        inside = np.zeros(n + 2, np.int8)
        inside[1:-1] = in_words(self.data)
        step = np.diff(inside)
        cut = self.at[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)])  # words of two rows that touch
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        if len(cut):
            self.start = np.sort(np.concatenate([self.start, cut]), kind="stable")  # merges the two
            self.end = np.sort(np.concatenate([self.end, cut]), kind="stable")
        sums = np.zeros(n + 1, U)
        np.cumsum(value[self.data] * _powers(n, _K)[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * _powers(n, _K_INVERSE)[self.start] + (self.end - self.start).astype(U))
        self.first = np.searchsorted(self.start, self.at)
        self.row = np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))


def grams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words within a row, and where each row's begin. A row of fewer words has one run of all of them; of none, none."""
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    begin = np.concatenate([[0], np.cumsum(runs)])
    total = int(begin[-1])
    row = np.repeat(np.arange(len(count)), runs)
    start = first[:-1][row] + (np.arange(total) - begin[:-1][row])
    padded = np.concatenate([hashes, np.zeros(n, U)])
    short = count[row] < n
    out = np.zeros(total, U)
    for k in range(n):
        part = padded[start + k]
        if short.any():
            part = np.where(short & (k >= count[row]), U(0), part)
        out = (out ^ part) * U(0xD6E8FEB86659FD93) + U(k + 1)
        out ^= out >> U(32)
    return mix(out), begin
