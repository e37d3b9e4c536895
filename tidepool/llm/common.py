"""Helpers that several operators share: input tables, shared storage, vectorised words.

Words are found in the UTF-8 bytes of an Arrow string column with numpy, so that a task spends
a few nanoseconds a byte instead of building a Python string for each word. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept, scratch, shared_path, written  # noqa: F401

#: Bytes of text that one numpy pass takes; longer batches are cut between documents.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> DataFrame:
    """doc_id and text alone, whatever other columns there are; a null text is empty."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text"))


def sealed(docs: DataFrame, *used: str):
    """docs with every column but the used ones under a name that no operator uses, and a function
    that gives a derived frame its old names back: (frame, names of results to add) -> frame with all
    columns of docs and the results. A result replaces a column of the same name."""
    names = [c if c in used else f"own_{i}__" for i, c in enumerate(docs.columns)]

    def back(df: DataFrame, *results: str) -> DataFrame:
        old = [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in results]
        return df.select(*old, *results)

    return docs.toDF(*names), back


def held_out():
    """Whether a row is kept from learning: crc32 of its id as text is divisible by 5. A null id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers, the same ones wherever they are computed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


BYTE = randoms(256, 1)
#: Of a byte's place in its word; a longer word goes on with further numbers of the same rule.
PLACE = randoms(1 << 12, 2)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of an Arrow string column; a null is empty."""
    import pyarrow as pa

    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    n = len(column)
    _, off, data = column.buffers()
    at = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(raw: np.ndarray, at: np.ndarray, size: int = CHUNK_BYTES):
    """Runs of whole documents of about size bytes: (first row, end row, bytes, offsets)."""
    row, n = 0, len(at) - 1
    while row < n:
        end = int(np.searchsorted(at, at[row] + size, side="right")) - 1
        end = min(n, max(row + 1, end))
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lookup(*members: tuple[int, int]) -> np.ndarray:
    """256 booleans, true in the given inclusive ranges."""
    out = np.zeros(256, bool)
    for a, b in members:
        out[a : b + 1] = True
    return out


#: ``[^\x20\x09-\x0D]``, and ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lowered.
NOT_SPACE = ~lookup((0x20, 0x20), (0x09, 0x0D))
ALNUM = lookup((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, at: np.ndarray, members: np.ndarray, lower: bool = True):
    """Hash, start and end byte of each word (a longest run of member bytes within a document),
    and the first word's number of each document (one more than documents)."""
    if lower:
        raw = LOWER[raw]
    n = len(raw)
    inside = members[raw] if n else np.zeros(0, bool)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edges = at[:-1][np.diff(at) > 0]  # a word ends with its document
    first[edges] = inside[edges]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(at), np.int64)
    sizes = ends - starts
    where = np.flatnonzero(inside)
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(where)) - np.repeat(begins, sizes)
    factors = PLACE if sizes.max() <= len(PLACE) else randoms(int(sizes.max()), 2)
    with np.errstate(over="ignore"):
        h = mix(np.add.reduceat(BYTE[raw[where]] * factors[place], begins) + sizes.astype(np.uint64))
    return h, starts, ends, np.searchsorted(starts, at)
