"""Columns over nucleotide strings."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import string_bytes

IUPAC = "^[ACGTNRYSWKMBDHV]+$"
#: Bases that each ambiguity code stands for (a fixed table).
AMBIGUITY = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def truncate(seq: Column, n: int = 256) -> Column:
    return F.substring(seq, 1, n)


def normalize(seq: Column) -> Column:
    return F.upper(F.trim(seq))


def is_iupac(seq: Column) -> Column:
    return seq.rlike(IUPAC)


def mask_ambiguous(seq: Column) -> Column:
    """Everything but A, C, G and T becomes N."""
    return F.regexp_replace(seq, "[^ACGT]", "N")


def reverse_complement(seq: Column) -> Column:
    """Of upper-case sequences; ambiguity codes are complemented too."""
    return F.reverse(F.translate(seq, "ACGTRYKMBVDH", "TGCAYRMKVBHD"))


def one_hot(seq: Column) -> Column:
    """A row of four 0/1 per base, in the order A, C, G, T; other symbols are all 0."""
    bases = F.filter(F.split(seq, ""), lambda b: b != "")
    return F.transform(bases, lambda b: F.array(*[(b == x).cast("int") for x in "ACGT"]))


def one_hot_digest():
    """A column function: (bases, a, c, g, t, bits) of ``one_hot``: its rows, the ones of each column, and the md5 of all
    numbers in a row. The matrices stay in their Arrow batch, one at a time."""
    table = np.zeros((256, 4), np.uint8)
    table[[ord(b) for b in "ACGT"], range(4)] = 1

    def value(seq: pd.Series) -> pd.DataFrame:
        out = []
        for s in seq:
            if s is None:
                out.append((None,) * 6)
                continue
            x = table[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
            out.append((len(x), *x.sum(0, dtype=np.int64).tolist(), md5((x + 48).tobytes()).hexdigest()))
        return pd.DataFrame(out, columns=["bases", *"acgt", "bits"]).astype(dict.fromkeys(["bases", *"acgt"], "Int64"))

    return F.pandas_udf(value, "bases long, a long, c long, g long, t long, bits string").asNondeterministic()


def kmers(seq: Column, k: int) -> Column:
    """Overlapping words of k clean bases; windows with another symbol are left out. A look-ahead
    finds them in one pass, however long the sequence is."""
    return F.regexp_extract_all(seq, F.lit(f"(?=([ACGT]{{{k}}}))"), F.lit(1))


def gc_fraction(seq: Column) -> Column:
    """Share of G and C among A, C, G and T; 0 without any."""
    gc, all_ = F.length(F.regexp_replace(seq, "[^GC]", "")), F.length(F.regexp_replace(seq, "[^ACGT]", ""))
    return F.when(all_ > 0, gc / all_).otherwise(0.0)


def phred(quality: Column) -> Column:
    """Phred+33 scores."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def _quality(of_scores):
    """A column function from the bytes of a quality string: a table of 256 values, summed a row."""

    def value(quality: pd.Series) -> pd.Series:
        raw, at = string_bytes(quality)
        sums = np.concatenate([[0.0], np.cumsum(of_scores[raw])]) if of_scores.dtype.kind == "i" else None
        if sums is None:  # floats are added row by row, so that long batches lose no digits
            some = np.flatnonzero(np.diff(at))
            out = np.zeros(len(at) - 1)
            if len(some):
                out[some] = np.add.reduceat(of_scores[raw], at[some])
            return pd.Series(out)
        return pd.Series((sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1))

    # a filter on the value isn't pushed below the projection that has it, where it would be computed again
    return F.pandas_udf(value, "double").asNondeterministic()


def mean_quality(quality: Column) -> Column:
    """Mean Phred+33 score; 0 for an empty or null string. Scores come from bytes in Arrow batches."""
    return _quality(np.arange(256) - 33)(quality)


def expected_errors(quality: Column) -> Column:
    """Sum of the error probabilities 10^(-score / 10); null for a null string."""
    return F.when(quality.isNotNull(), _quality(10.0 ** (-(np.arange(256) - 33.0) / 10))(quality))


#: An odd number, whose powers weigh places in 64-bit sums, and its inverse.
WEIGHT = 0x9E3779B97F4A7C15
UNWEIGHT = pow(WEIGHT, -1, 1 << 64)


def overlap(a: str | None, b: str | None, least: int) -> int:
    """Length of the longest end of a, of ``least`` letters or more, that b begins with; 0 if there is none.

    Weighted sums of all ends and of all beginnings are compared in one pass, and equal ones letter by letter, the longest first.
    """
    most = min(len(a or ""), len(b or ""))
    if most < max(least, 1):
        return 0
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64) for s in (a[-most:], b[:most]))
    up, down = (np.cumprod(np.full(most, w, np.uint64)) for w in (WEIGHT, UNWEIGHT))
    # the end from place i on is divided by the weight of that place, so that it weighs as a beginning does
    ends = np.cumsum((x * up)[::-1])[::-1] * down
    begins = (np.cumsum(y * up) * np.uint64(UNWEIGHT))[::-1]
    for i in np.flatnonzero(ends == begins):
        n = most - int(i)
        if n < least:
            break
        if a[len(a) - n :] == b[:n]:
            return n
    return 0


def longest_overlap(least: int):
    """A column function: ``overlap`` of two strings."""

    def value(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([overlap(x, y, least) for x, y in zip(a, b, strict=True)], dtype="int32")

    # the overlap is used several times, and a deterministic function would be called for each
    return F.pandas_udf(value, "int").asNondeterministic()


def primer_pattern(primer: str) -> str:
    return "^" + "".join(f"[{AMBIGUITY[b]}]" if b in AMBIGUITY else b for b in primer.upper())
