"""Best-fit packing planned on the histogram of piece lengths.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut, and
only their first piece may be shorter than the others. The lengths of all pieces are counted, and
best-fit decreasing runs over those counts: pieces of one length are placed together, into the
fullest open sequences that still take one. The plan is a list of runs (of one length: so many
pieces, from this sequence on, so many in each, from this offset on). Its size depends on the
capacity and not on the number of documents. A piece then takes the planned slot of its rank
among the pieces of its length.

Ranks are dealt out in two steps, so that no length meets in one task: numbers within (length,
salt), and the running sum of the counts of the (length, salt) groups before it. A length gets
salts by its share of all pieces, so groups are alike however common a length is.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, text_of, written
from .token_count import PATTERN, byte_letters

CAPACITY = 1024
END = 2
#: (length, salt) groups for each shuffle partition of the session, beside one for each length.
GROUPS_A_PARTITION = 8
_encoders: dict = {}


class Encoder:
    """Ids of a byte-level BPE file for ``tokenizers``. tiktoken, on the same vocabulary and special
    strings, gives them about four times as fast; its pattern engine gives up on white space that
    goes on for about a million characters, and then the library itself encodes the text."""

    def __init__(self, path: str):
        import tiktoken

        spec, letters = json.loads(Path(path).read_text(encoding="utf-8")), byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        self.path, self.library = path, None
        self.fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """One for each worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row's token ids and the end id."""

    def run(batches):
        import pyarrow as pa

        enc = encoder(path)
        for b in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            texts, doc = b.column("text"), b.column("doc_id")
            for row in range(len(texts)):
                t = np.append(enc.ids(texts[row].as_py()), end).astype("<u4")
                at, k, own = 0, 0, doc[row].as_py()
                while at < len(t):
                    to = at + ((len(t) - at) % capacity or capacity)
                    ids.append(own)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(t[at:to].tobytes()))
                    at, k = to, k + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces in each sequence, first offset).

    Open sequences are kept by the room they have left, as (first, number) stretches. Of
    each length, largest first, the sequences with least sufficient room are filled, then new ones.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, fresh = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        fits = sorted(r for r in room if r >= length and room[r])
        while left:
            if fits:
                space = fits[0]
                first, number = room[space].pop()
                if not room[space]:
                    fits.pop(0)
            else:
                space, first = capacity, fresh
                number = -(-left // (capacity // length))
                fresh += number
            each = space // length
            full = min(number, left // each)
            more = left - full * each if full < number else 0  # for one sequence that isn't filled
            for begin, n, k in ((first, full, each), (first + full, 1, more)):
                if n and k:
                    runs.append((length, rank, n * k, begin, k, capacity - space))
                    room[space - k * length].append((begin, n))
                    rank, left = rank + n * k, left - n * k
            used = full + (more > 0)
            if used < number:
                room[space].append((first + used, number - used))
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (doc_id, piece, length, ...; a table that stays as it is) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    shares = GROUPS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = spark.createDataFrame([(k, max(1, n * shares // sum(counts.values()))) for k, n in counts.items()], "_k long, _salts long")
    salted = pieces.join(F.broadcast(salts), F.col("length") == F.col("_k")).withColumn("_s", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "_salts"))
    salted = salted.select(*pieces.columns, "_s")
    groups = salted.groupBy("length", "_s").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    base = groups.select(F.col("length").alias("_l"), F.col("_s").alias("_t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy("length", "_s").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_r", F.row_number().over(within) - 1)
    ranked = ranked.join(base, (F.col("length") == F.col("_l")) & (F.col("_s") == F.col("_t"))).withColumn("_r", F.col("_r") + F.col("_base"))
    runs = spark.createDataFrame(plan(counts, capacity), "_length long, _first long, _n long, _sequence long, _each long, _offset long")
    by_length = runs.groupBy("_length").agg(F.array_sort(F.collect_list(F.struct("_first", "_n", "_sequence", "_each", "_offset"))).alias("_runs"))
    slot = ranked.join(F.broadcast(by_length), F.col("length") == F.col("_length"))
    mine = F.filter("_runs", lambda r: (F.col("_r") >= r["_first"]) & (F.col("_r") < r["_first"] + r["_n"]))
    slot = slot.withColumn("_m", F.get(mine, F.lit(0)))
    k = F.col("_r") - F.col("_m._first")
    number = F.floor(k / F.col("_m._each"))
    return slot.select(*pieces.columns, (F.col("_m._sequence") + number).alias("sequence_id"), (F.col("_m._offset") + (k - number * F.col("_m._each")) * F.col("length")).alias("offset"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start, length, ids_crc32 (of the little-endian
    32-bit ids), sequence_id, offset. Sequences are numbered from 0 and have no gaps.

    A null or empty text is the end id alone. Repeated rows are packed each by itself; a null
    doc_id stays null; other columns are not read. Without rows the result is empty.
    """
    return place(written(cut_pieces(docs, path, capacity, end), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
