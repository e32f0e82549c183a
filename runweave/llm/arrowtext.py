"""Arrow string columns as numpy arrays and back, without a call per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, offsets starting at 0; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type)
    if not (wide or pa.types.is_string(col.type)):
        col, wide = col.cast(pa.string()), False
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    at = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def to_codes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes to code points. Bytes that are no UTF-8 become U+FFFD."""
    try:
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return codes, starts[at]
    except UnicodeDecodeError:
        data = raw.tobytes()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        return codes, np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)


def from_codes(codes: np.ndarray, at: np.ndarray) -> pa.Array:
    """Code points to a string column."""
    data = codes.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace")
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(width)])[at]
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data))


def any_in(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row, whether one of its elements is flagged."""
    c = np.concatenate([[0], np.cumsum(flags)])
    return c[at[1:]] > c[at[:-1]]


def take_rows(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements of the rows at the given places, in their order."""
    n = at[rows + 1] - at[rows]
    out = np.concatenate([[0], np.cumsum(n)])
    index = np.repeat(at[rows] - out[:-1], n) + np.arange(out[-1])
    return values[index], out
