"""Text columns as flat byte arrays, so that numpy works on many rows at once.

A block is a run of rows of one Arrow batch: ``data`` holds the UTF-8 bytes of
its texts back to back and ``offs`` (rows + 1) where each begins. Null texts
are empty. Blocks are cut at about ``TARGET`` bytes; a longer text is a block
of its own, so a task needs memory in proportion to its longest text.
"""

from __future__ import annotations

import ctypes
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TARGET = 1 << 21

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of words without ASCII punctuation: digits, letters, all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240131)
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string (or binary) column and where each row begins."""
    kind = pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(offs) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    flat = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return flat, offs - offs[0]


def byte_list(column: pa.Array) -> list[bytes]:
    """The values of a large binary column without nulls; faster than to_pylist."""
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in itertools.pairwise(offs)]


def blocks(batch: pa.RecordBatch, column: str = "text", target: int = TARGET):
    """Yields (rows, data, offs) for runs of rows of about ``target`` bytes."""
    data, offs = text_bytes(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, side="right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only


def release() -> None:
    """Gives freed memory back to the system: workers stay for later stages, and what each keeps adds up in an executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def mapper(work, column: str = "text", target: int = TARGET):
    """A mapInArrow function that applies ``work(rows, data, offs)`` to each block."""

    def run(batches):
        for batch in batches:
            for rows, data, offs in blocks(batch, column, target):
                out = work(rows, data, offs)
                if out is not None and out.num_rows:
                    yield out
        release()

    return run


def lists(flat: np.ndarray, counts: np.ndarray, width: int | None = None) -> pa.Array:
    """A binary column of the raw little-endian bytes of ragged rows."""
    raw = np.ascontiguousarray(flat)
    offs = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offs[1:])
    offs *= width or raw.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offs), pa.py_buffer(raw)]).cast(pa.binary())


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes, and each row's first run (rows + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    mask = inside[data]
    before = np.empty_like(mask)
    before[0] = False
    before[1:] = mask[:-1]
    edges = offs[:-1][offs[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(mask & ~before)
    after = np.empty_like(mask)
    after[-1] = False
    after[:-1] = mask[1:]
    edges = offs[1:][offs[1:] > 0] - 1
    after[edges] = False
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, TARGET + 1, 2 * len(_powers) if len(_powers) < TARGET else 0)
        _powers = np.full(size, _BASE, np.uint64)
        _inverses = np.full(size, _INVERSE, np.uint64)
        _powers[0] = _inverses[0] = 1
        np.cumprod(_powers, out=_powers)
        np.cumprod(_inverses, out=_inverses)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial rolling hash modulo 2**64."""
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    values = _VALUE[data]
    values *= _powers[: len(data)]
    np.cumsum(values, out=sums[1:])
    return sums


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans' bytes, the same wherever the bytes stand."""
    h = sums[ends] - sums[starts]
    h *= _inverses[starts]
    h += (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(h)


def window_hash(sums: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of ``length`` bytes."""
    n = len(sums) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = sums[length:] - sums[:-length]
    h *= _inverses[:n]
    return mix(h)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the half-open ranges between successive bounds."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def gather(table: np.ndarray, table_offs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows ``ids`` of a flat table back to back, and their lengths."""
    counts = table_offs[ids + 1] - table_offs[ids]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(table_offs[ids] - (ends - counts), counts)
    return table[at], counts
