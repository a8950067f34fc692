"""Arrow text <-> numpy code points, one conversion per slice of a batch and none per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of UTF-8 worked on at once; bounds the numpy arrays of a task whatever the Arrow batch holds.
SLICE_BYTES = 1 << 22


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of 64-bit offset strings."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.large_string())


def byte_offsets(column: pa.Array) -> np.ndarray:
    """Byte offset of every row in the column's data buffer (null rows are empty)."""
    raw = np.frombuffer(column.buffers()[1], np.int64)
    return raw[column.offset : column.offset + len(column) + 1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; a longer row is a range of its own."""
    off = byte_offsets(column) if len(column) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi
        lo = hi


def to_codepoints(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows, end to end, and each row's offset among them."""
    if not len(column):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    off = byte_offsets(column)
    data = column.buffers()[2]
    raw = memoryview(data)[off[0] : off[-1]] if data is not None else b""
    text = str(raw, "utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
    return np.frombuffer(text, np.uint32), counts_before(np.frombuffer(raw, np.int8) >= -64, off - off[0])


def counts_before(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set before each of the rows' offsets."""
    out = np.zeros(len(offsets), np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full + 1] = np.add.reduceat(flags.view(np.uint8), offsets[full], dtype=np.int64)
    return np.cumsum(out)


def to_strings(cps: np.ndarray, offsets: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The rows as a large_string array; rows that are not `valid` are null."""
    data = cps.astype("<u4", copy=False).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    mask = None
    at = offsets.copy()
    for floor in (0x80, 0x800, 0x10000):
        at += counts_before(cps >= floor, offsets)
    if valid is not None and not valid.all():
        mask = pa.py_buffer(np.packbits(valid, bitorder="little"))
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(at), pa.py_buffer(data), mask)


def row_starts(n: int, offsets: np.ndarray) -> np.ndarray:
    """True at the first code point of every row that has one."""
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return first


def keep(cps: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points that are kept, with the rows' new offsets."""
    return cps[kept], counts_before(kept, offsets)
