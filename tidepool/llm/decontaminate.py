"""Benchmark decontamination with suffix arrays over shards of the training texts.

A task cuts its documents into shards of some megabytes. The words of a shard, as 64-bit hashes with a
separator after each document, get a suffix array by prefix doubling, as deep as the longest test
item. Every suffix of every item is then binary-searched for the stretch of the array that begins
with its first window (13 words, or the whole of a shorter item); suffixes that begin alike are
searched once. Each document place of a stretch is a hit, and hits of an item that follow one
another in both texts join into its longest verbatim matches. Where a window repeats within an item,
a place goes on with the match before it if it can, and else begins one at the item's first such
place, so that a place has one match an item however repetitive both texts are. Documents aren't
shuffled; items go to the executors in blocks of bounded size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, chunks, kept, mix, randoms, scratch, sealed, table, utf8, words, written

WINDOW = 13
SHARD_BYTES = 3_000_000
#: UTF-8 bytes of items in one broadcast block; more items make more blocks.
BLOCK_BYTES = 16_000_000
#: Windows that are searched at once.
SLICE = 1 << 16
MATCHES = "array<struct<item_id:string,item_start:int,doc_start:int,length:int>>"


def suffix_array(h: np.ndarray, depth: int) -> np.ndarray:
    """Start places of all suffixes of h, in the order of their first ``depth`` elements at least."""
    n = len(h)
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.ones(n, bool)
    new[1:] = s[1:] != s[:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[order] = start
    rank[n] = -1
    k = 1
    slots = _tied(new)
    while len(slots) and k < depth:
        sub = order[slots]
        a, b = rank[sub], rank[np.minimum(sub + k, n)]
        by = np.lexsort((b, a))
        sub, a, b = sub[by], a[by], b[by]
        order[slots] = sub
        new = np.ones(len(sub), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank[sub] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[_tied(new)]
        k *= 2
    return order


def _tied(new: np.ndarray) -> np.ndarray:
    """Places of the elements in groups of two or more; new marks the first of each group."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


def find(h: np.ndarray, order: np.ndarray, items: np.ndarray, at: np.ndarray, width: int):
    """For each of the places ``at`` in ``items``: the stretch (low, high) of ``order`` whose
    suffixes begin with the ``width`` elements there."""
    n = len(h)
    padded = np.concatenate([h, np.zeros(width, h.dtype)])

    def bound(want: np.ndarray, upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(want), np.int64), np.full(len(want), n)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            have = padded[order[mid][:, None] + np.arange(width)]
            w = want[open_]
            differ = have != w
            j = differ.argmax(1)
            r = np.arange(len(j))
            less = have[r, j] < w[r, j]
            equal = ~differ[r, j]
            right = less | (equal & upper)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
        return lo

    low, high = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for i in range(0, len(at), SLICE):
        want = items[at[i : i + SLICE, None] + np.arange(width)]
        low[i : i + SLICE], high[i : i + SLICE] = bound(want, False), bound(want, True)
    return low, high


class Windows:
    """The windows of one width: each different one once, and the places of the items that have it."""

    def __init__(self, block: Block, width: int, at: np.ndarray):
        r = randoms(width, 30)
        with np.errstate(over="ignore"):
            key = np.zeros(len(at), np.uint64)
            for j in range(width):
                key += block.hashes[at + j] * r[j]
        _, first, kind = np.unique(mix(key), return_index=True, return_inverse=True)
        self.width, self.at = width, at[first]
        item, place = block.item[at], at - block.first[block.item[at]]
        by = np.lexsort((place, item, kind))
        kind, item, place = kind[by], item[by], place[by]
        new = np.ones(len(kind), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (item[1:] != item[:-1])
        begin = np.flatnonzero(new)
        #: of each (window, item): the item, its first such place, and whether there are more
        self.item, self.place, self.more = item[begin], place[begin], np.diff(np.append(begin, len(kind))) > 1
        self.begin = np.searchsorted(kind[begin], np.arange(len(self.at) + 1))


class Block:
    """Test items, ready to be searched: hashes in a row, suffixes by the width of their window."""

    def __init__(self, ids: list[str], texts: list[str]):
        import pyarrow as pa

        raw, off = utf8(pa.array(texts, pa.large_string()))
        h, _, _, first = words(raw, off, ALNUM)
        self.ids, self.hashes, self.item = ids, h, np.repeat(np.arange(len(ids)), np.diff(first))
        self.first, self.longest = first, int(np.diff(first).max(initial=0))
        sizes = np.diff(first)[self.item]
        width = np.minimum(sizes, WINDOW)
        left = first[self.item + 1] - np.arange(len(h))
        self.windows = [Windows(self, int(w), np.flatnonzero((width == w) & (left >= w))) for w in np.unique(width)]

    def hits(self, h: np.ndarray, order: np.ndarray, present: np.ndarray):
        """For each width (windows, places in h sorted, window at each). present: sorted hashes."""
        for w in self.windows:
            first = np.searchsorted(present, self.hashes[w.at])
            some = np.flatnonzero(present[np.minimum(first, len(present) - 1)] == self.hashes[w.at])
            if not len(some):
                continue
            low, high = find(h, order, self.hashes, w.at[some], w.width)
            n = high - low
            place = order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            kind = np.repeat(some, n)
            by = np.argsort(place, kind="stable")
            if len(place):
                yield w, place[by], kind[by]

    def matches(self, w: Windows, place: np.ndarray, kind: np.ndarray):
        """Longest matches of one document as arrays: item, item start, place, length."""
        n = w.begin[kind + 1] - w.begin[kind]
        row = np.repeat(w.begin[kind], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        p, item, q, more = np.repeat(place, n), w.item[row], w.place[row], w.more[row]
        by = np.lexsort((p, item))
        p, item, q, more = p[by], item[by], q[by], more[by]
        if more.any():  # windows that repeat within their item: go on with the match before, or with the next one
            q, own = q.copy(), np.repeat(kind, n)[by]
            joined = (np.diff(item) == 0) & (np.diff(p) == 1)

            def there(i: int, place: int) -> bool:
                at, size = self.first[item[i]] + place, w.width
                if place < 0 or at + size > self.first[item[i] + 1]:
                    return False
                return bool((self.hashes[at : at + size] == self.hashes[w.at[own[i]] : w.at[own[i]] + size]).all())

            for i in (np.flatnonzero(joined & more[1:]) + 1).tolist():
                if there(i, q[i - 1] + 1):
                    q[i] = q[i - 1] + 1
            for i in np.flatnonzero(joined & more[:-1])[::-1].tolist():
                if q[i] + 1 != q[i + 1] and there(i, q[i + 1] - 1):
                    q[i] = q[i + 1] - 1
        new = np.ones(len(p), bool)
        new[1:] = (item[1:] != item[:-1]) | (np.diff(p - q) != 0) | (np.diff(p) != 1)
        begin = np.flatnonzero(new)
        return item[begin], q[begin], p[begin], np.diff(np.append(begin, len(p))) - 1 + w.width


def _search(block):
    def run(batches):
        import pyarrow as pa

        b = block.value
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for row, end, bytes_, off in chunks(raw, at, SHARD_BYTES):
                h, _, _, first = words(bytes_, off, ALNUM)
                n, sizes = end - row, np.diff(first)
                lists: list[list] = [[] for _ in range(n)]
                begins = first[:-1] + np.arange(n)  # with a separator after each document
                if len(h) and len(b.hashes):
                    shard = np.zeros(len(h) + n, np.uint64)
                    shard[np.arange(len(h)) + np.repeat(np.arange(n), sizes)] = h
                    order = suffix_array(shard, max(b.longest, WINDOW))
                    for w, place, kind in b.hits(shard, order, shard[order]):
                        doc = np.searchsorted(begins, place, side="right") - 1
                        edges = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
                        for i, j in zip(edges[:-1], edges[1:], strict=True):
                            d = doc[i]
                            for item, s, p, m in zip(*(x.tolist() for x in b.matches(w, place[i:j] - begins[d], kind[i:j])), strict=True):
                                lists[d].append({"item_id": b.ids[item], "item_start": s, "doc_start": p, "length": m})
                kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
                rest = batch.slice(row, n)
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sizes, pa.int64()), pa.array(lists, kind)], [*batch.schema.names, "n_words", "matches"])

    return run


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All columns of docs with n_words and matches: each row's longest verbatim matches with
    items, as (item_id, item_start, doc_start, length) in words.

    Null texts have no words; items without words or with a null text are never found; a null
    item_id counts as the item ''. Items with equal ids count as one. Repeated rows are searched each
    by itself. Columns of docs named n_words or matches are replaced, others stay whatever they are
    called. With one block of items, the usual case, nothing is shuffled; with more, the matches of
    each block are joined to the rows by doc_id and a hash of the text.
    """
    spark = docs.sparkSession
    docs, back = sealed(docs, "doc_id", "text")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = size // BLOCK_BYTES + 1
    schema = lambda df: T.StructType([*df.schema.fields, T.StructField("n_words", T.LongType()), *T._parse_datatype_string(f"matches {MATCHES}").fields])

    def searched(rows: DataFrame, own: DataFrame) -> DataFrame:
        got = own.orderBy("item_id", "text").collect()  # at most about BLOCK_BYTES
        block = spark.sparkContext.broadcast(Block([r[0] for r in got], [r[1] for r in got]))
        return rows.mapInArrow(_search(block), schema(rows))

    if blocks == 1:
        return back(searched(docs, items), "n_words", "matches")
    keyed = docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_j"), "text").dropDuplicates(["_d", "_j"])
    with scratch():
        found = [written(searched(keyed, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)).drop("text"), "matches") for b in range(blocks)]
        every = reduce(DataFrame.unionByName, found).groupBy("_d", "_j", "n_words").agg(F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
        every = kept(every, "matches")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_j"))
    return back(docs.join(every, same), "n_words", "matches")


def words_hit(matches: Column | str = "matches") -> Column:
    """Words under any of the matches."""
    spans = F.sort_array(F.transform(matches, lambda m: F.struct(m["doc_start"].alias("a"), (m["doc_start"] + m["length"]).alias("b"))))
    start = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda s, m: F.struct(F.greatest(s["to"], m["b"]).alias("to"), (s["n"] + F.greatest(F.lit(0), m["b"] - F.greatest(s["to"], m["a"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda s: s["n"])


def judge(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """find_matches, with n_hit, items (ids in string order) and contaminated: at least one word in
    ``share`` is hit, and one at all. Every row of docs is judged, repeated ones each by itself;
    columns of docs with the names of results are replaced."""
    docs, back = sealed(docs, "doc_id", "text")
    out = find_matches(docs, benchmark).withColumn("n_hit", words_hit())
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    out = out.withColumns({"items": items, "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))})
    return back(out, "n_words", "matches", "n_hit", "items", "contaminated")


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """docs without the contaminated ones, all columns as they were, whatever they are called."""
    docs, back = sealed(docs, "doc_id", "text")
    return back(judge(docs, benchmark, share).where(~F.col("contaminated")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


JUDGE_SQL = r"""
WITH dw AS (SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w FROM {documents}),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS p FROM iw WHERE len(w) > 0),
ig AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM ip),
ns AS (SELECT DISTINCT n FROM ig),
dp AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM dw, ns WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, dp.n, p FROM dp JOIN ig ON dp.n = ig.n AND array_to_string(w[p : p + dp.n - 1], ' ') = g),
cover AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
judged AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
  FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN it USING (doc_id))
"""
SQL = JUDGE_SQL.format(documents="documents") + "SELECT * FROM judged"
