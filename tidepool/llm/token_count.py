"""Token counts by byte-pair merging, without token ids.

A text is cut into pieces by the tokenizer's own pattern. The symbols of a piece (its bytes)
form a linked list; the adjacent pairs that have a rank wait in a heap. The pair of lowest rank,
leftmost first, is merged again and again; each merge removes one symbol, so the count is the
number of bytes minus the number of merges. Pieces repeat a lot, so each Python worker remembers
the counts of the pieces it has met, up to a fixed number of them.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: The pattern of byte-level BPE files that say "ByteLevel" with use_regex (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose counts a worker remembers; then it forgets them all and starts again. Pieces of more
#: characters than SHORT aren't remembered.
REMEMBERED, SHORT = 2_000_000, 64


def byte_letters() -> dict[str, int]:
    """The printable letters that byte-level vocabularies write for bytes: printable Latin-1
    bytes stand for themselves, the others follow from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counts(dict):
    """Piece -> number of tokens, computed when first asked for."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("a byte-level BPE file without normalizer and prefix space is needed")
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left bytes, right bytes) -> rank
        self.ranks = {(to_bytes(a), to_bytes(b)): i for i, (a, b) in enumerate(merges)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = merged(piece.encode("utf-8", "replace"), self.ranks)
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        """Special strings inside the text are one token each, as the library has it."""
        if self.special is None or not self.special.search(text):
            return sum(map(self.__getitem__, self.pieces(text)))
        parts = self.special.split(text)
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(p))) for p in parts)


def merged(piece: bytes, ranks: dict) -> int:
    """Symbols left of a piece when no adjacent pair has a rank."""
    n = len(piece)
    if n < 2:
        return n
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = ranks.get
    heap = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := rank((symbol[i], symbol[i + 1]))) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != a or j >= n or symbol[j] != b:
            continue  # one side has been merged since
        symbol[i], symbol[j] = a + b, None
        k = after[i] = after[j]
        left -= 1
        if k < n:
            before[k] = i
            if (r := rank((symbol[i], symbol[k]))) is not None:
                heapq.heappush(heap, (r, i, symbol[i], symbol[k]))
        if (p := before[i]) >= 0 and (r := rank((symbol[p], symbol[i]))) is not None:
            heapq.heappush(heap, (r, p, symbol[p], symbol[i]))
    return left


_loaded: dict[str, Counts] = {}


def counter(path: str) -> Counts:
    """One for each worker and file; it stays while the worker lives."""
    if path not in _loaded:
        _loaded[path] = Counts(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of each row.

    A null text is empty and has 0 tokens; repeated rows are counted each by itself; a null
    doc_id stays null; other columns are not read. No shuffle.
    """
    def run(batches):
        import pyarrow as pa

        get = counter(path)
        for b in batches:
            column = b.column("text")
            n = [get.count(column[i].as_py()) for i in range(len(column))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = text_of(docs, text).select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
