"""Arrow string batches as numpy bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that one numpy pass takes, and one whose results are kept by row; a longer string is taken whole.
CHUNK_BYTES, FEW_BYTES = 2_000_000, 200_000
#: Number of each base, 4 for everything else.
BASE = np.full(256, 4, np.int64)
BASE[[ord(b) for b in "ACGT"]] = range(4)


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string array; a null is empty."""
    import pyarrow as pa

    column = pa.array(column, pa.large_string()) if not isinstance(column, pa.Array) else column.cast(pa.large_string())
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(raw: np.ndarray, at: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about so many bytes: (first row, end row, bytes, offsets)."""
    row, n = 0, len(at) - 1
    while row < n:
        end = min(n, max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1))
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def kmer_codes(raw: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(base-4 number, row) of every word of k clean bases within a row."""
    base, row = BASE[raw], np.repeat(np.arange(len(at) - 1), np.diff(at))
    m = len(raw) - k + 1
    if m < 1:
        return np.zeros(0, np.int64), row[:0]
    bad = np.concatenate([[0], np.cumsum(base > 3)])
    ok = (bad[k : k + m] == bad[:m]) & (row[k - 1 :] == row[:m])
    code = np.zeros(m, np.int64)
    for j in range(k):
        code = code * 4 + base[j : j + m]
    return code[ok], row[:m][ok]


def lists(values: np.ndarray):
    """An Arrow array with a list for each row of a matrix."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1)))
