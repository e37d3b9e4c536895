"""Texts as arrays of code points, and hashes of words and their parts, for numpy.

A batch of texts is one array; every text stands between blanks, so that its first and last word
have edges like the others. Hashes have 64 bits and are the same wherever they are computed.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

from .common import PLACE, mix

#: Characters that one numpy pass takes; a longer text is taken whole.
CHUNK_CHARS = 500_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def text_chunks(texts: list[str], size: int = CHUNK_CHARS):
    """Runs of texts of about size characters: (first row, end row)."""
    row, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield row, i
            row, held = i, 0
        held += len(t) + 1
    if row < len(texts):
        yield row, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, place of each text's first character); a line end follows each text, and one is
    before the first."""
    big = "\n" + "".join(f"{t}\n" for t in texts)
    at = np.cumsum([1, *[len(t) + 1 for t in texts]])
    return np.frombuffer(big.encode("utf-32-le"), np.uint32), at


@cache
def _plane() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1 << 16, dtype=np.uint64) + np.uint64(1)) * STEP)


def char_hashes(c: np.ndarray) -> np.ndarray:
    """A random number for each code point."""
    if len(c) and c.max() >= 1 << 16:
        with np.errstate(over="ignore"):
            return mix((c.astype(np.uint64) + np.uint64(1)) * STEP)
    return _plane()[c]


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of true. Texts stand between false places."""
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def prefix_sums(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """sums[i + 1] - sums[start] hashes the part of a run from its start to place i (modulo 2^64)."""
    value = np.zeros(len(c) + 1, np.uint64)
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(begins, sizes)
    where = place + np.repeat(starts, sizes)
    with np.errstate(over="ignore"):
        value[where + 1] = char_hashes(c[where]) * PLACE[place % len(PLACE)]
        return np.cumsum(value, dtype=np.uint64)


def part_hashes(sums: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int, seed: int) -> np.ndarray:
    """A hash of the first ``sizes`` characters of the runs at ``starts``, by size and seed."""
    with np.errstate(over="ignore"):
        return mix(sums[starts + sizes] - sums[starts] + (np.asarray(sizes, np.uint64) + np.uint64(seed << 32)) * STEP)


@cache
def letter_classes() -> np.ndarray:
    """Of each code point: 1 to 26 for a letter whose form without accents is a to z (lower case), 27
    for other letters, 0 for the rest."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        if chr(i).isalpha():
            base = unicodedata.normalize("NFKD", chr(i))[0]
            out[i] = ord(base) - 96 if "a" <= base <= "z" else 27
    return out
