"""MD5 of many texts at once, as far as telling small digests needs it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

#: Texts that one numpy pass takes.
PASS = 32_768
#: Start, shifts, constants and order of words of the 64 steps of MD5.
START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
SHIFTS = [np.array(s, np.uint32) for s in ([7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21])]
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
ORDER = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]


def _steps(words: list[np.ndarray | int], state: list[np.ndarray], steps: int) -> list[np.ndarray]:
    """The state after some steps on a block of 16 words; a word that all texts share is a number."""
    a, b, c, d = (x.copy() for x in state)
    t = np.empty_like(a)
    for i in range(steps):
        if i < 16:
            np.bitwise_and(np.bitwise_xor(c, d, out=t), b, out=t)
            t ^= d
        elif i < 32:
            np.bitwise_and(np.bitwise_xor(b, c, out=t), d, out=t)
            t ^= c
        elif i < 48:
            np.bitwise_xor(np.bitwise_xor(b, c, out=t), d, out=t)
        else:
            np.bitwise_or(np.invert(d, out=t), b, out=t)
            t ^= c
        t += a
        word, left = words[ORDER[i]], SHIFTS[i // 16][i % 4]
        if isinstance(word, int):
            t += np.uint32((SINES[i] + word) % 2**32)
        else:
            t += word
            t += np.uint32(SINES[i])
        np.left_shift(t, left, out=a)
        t >>= np.uint32(32) - left
        a |= t
        a += b
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


def heads(words: list[np.ndarray | int], n: int) -> np.ndarray:
    """The first four bytes, as a number, of the digests of n texts, given as padded words of 4 bytes."""
    state = [np.full(n, x) for x in START]
    for at in range(0, len(words) - 16, 16):
        state = [x + y for x, y in zip(state, _steps(words[at : at + 16], state, 64), strict=True)]
    # the last three steps of the last block make other bytes
    return (state[0] + _steps(words[-16:], state, 61)[1]).byteswap()


def small_digests(raw: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, i): the numbers i from low to high of each text (bytes and offsets) for which the first four bytes of
    md5(text + i in decimal digits) are at most the text's bound. Texts and numbers of the same lengths go together."""
    length = np.diff(at)
    for size in np.unique(length):
        own = np.flatnonzero(length == size)
        text = raw[at[own][:, None] + np.arange(size)]
        for digits in range(len(str(int(low[own].min()))), len(str(int(high[own].max()))) + 1):
            first = np.maximum(low[own], 10 ** (digits - 1))
            end = np.cumsum(np.maximum(np.minimum(high[own], 10**digits - 1) - first + 1, 0))
            begin = np.concatenate([[0], end[:-1]])
            whole = int(size) + digits
            padded = np.zeros((len(own), ((whole + 8) // 64 + 1) * 64), np.uint8)
            padded[:, :size], padded[:, whole] = text, 0x80
            varied = padded[:, : whole // 4 * 4 + 4].view("<u4").T.astype(np.uint32)
            rest = [0] * (padded.shape[1] // 4 - len(varied) - 2) + [whole * 8 % 2**32, whole * 8 >> 32]
            for x in range(0, int(end[-1]), PASS):
                y = min(x + PASS, int(end[-1]))
                some = np.arange(np.searchsorted(end, x, side="right"), np.searchsorted(end, y - 1, side="right") + 1)
                of = np.repeat(some, np.minimum(end[some], y) - np.maximum(begin[some], x))
                i = np.arange(x, y) - begin[of] + first[of]
                words, left = [w[of] for w in varied], i
                for place in range(whole - 1, int(size) - 1, -1):
                    left, digit = left // 10, left
                    words[place // 4] |= (digit - 10 * left + 48).astype(np.uint32) << np.uint32(place % 4 * 8)
                hit = np.flatnonzero(heads([*words, *rest], y - x) <= bound[own][of])
                yield own[of[hit]], i[hit]
