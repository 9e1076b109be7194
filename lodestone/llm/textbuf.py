"""Vectorised text primitives over Arrow string buffers.

A column of texts is one UTF-8 byte array plus row offsets. Everything here
works on whole byte arrays with numpy, so per-row Python is paid for once per
slice, not once per word. Slices are bounded in bytes; a single text longer
than the bound is a slice of its own and is still processed whole.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
HASH_BYTES = 1 << 18

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(_R), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


@dataclass
class TextSlice:
    """Rows ``lo`` to ``hi`` of a record batch and their bytes."""

    batch: pa.RecordBatch
    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def column(self, name: str) -> pa.Array:
        return self.batch.column(self.batch.schema.get_field_index(name)).slice(self.lo, self.n)

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.type != pa.string():
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def text_slices(batches, text: str = "text", max_bytes: int = SLICE_BYTES, lower: bool = False) -> Iterator[TextSlice]:
    """Cuts record batches into slices of at most ``max_bytes`` of text."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        data, offs = string_buffers(col)
        lo, n = 0, len(offs) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
            part, start = data[offs[lo] : offs[hi]], offs[lo]
            cut = offs[lo : hi + 1] - start
            if lower and len(part):
                low = pc.utf8_lower(col.slice(lo, hi - lo).cast(pa.string()))
                part, cut = string_buffers(low)
            yield TextSlice(batch, lo, hi, part, cut)
            lo = hi
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: workers live on and others share the executor's limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for k, base in ((0, _R), (1, _R_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span (starts ascending); equal bytes give equal hashes.

    Spans are hashed in blocks of ``HASH_BYTES``, so scratch memory follows the block, not the slice.
    """
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + HASH_BYTES)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        total = np.zeros(hi - lo + 1, np.uint64)
        pw, inv = _powers(hi - lo + 1)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * pw[:-1], out=total[1:])
        out[i:j] = (total[ends[i:j] - lo] - total[starts[i:j] - lo]) * inv[starts[i:j] - lo]
        i = j
    return mix64(out ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


def byte_table(chars: bytes = b"", high: bool = True) -> np.ndarray:
    """A 256-entry table that is true for the given bytes and, if ``high``, for bytes from 0x80."""
    t = np.zeros(256, bool)
    t[list(chars)] = True
    if high:
        t[128:] = True
    return t


ALNUM = byte_table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LETTERS = byte_table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def runs(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, and the run offsets of every row; runs end at row ends."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    before = np.empty(n, bool)
    before[0], before[1:] = False, mask[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, mask[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as an Arrow string array."""
    size = ends - starts
    offs = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(size, out=offs[1:])
    picked = data[np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(picked)))


def segment_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive offsets; empty segments give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
