"""N-gram Jaccard join: which texts share at least ``percent`` % of their word shingles.

1. Every text becomes a set of 64-bit shingle hashes. Texts with equal sets are one node (a hash of
   the set); copies are never compared.
2. Shingles are ordered rare first. How common one is comes from all texts: each task counts the
   shingles of its different sets in blocks and adds those that repeat within a block to a fixed number of
   hash buckets (so the many that occur once don't blur the counts of the others). Ties are broken
   by hash, so the order is total; the result doesn't depend on it.
3. Two sets that are similar enough share a shingle among the first n - ceil(t n) + 1 of both.
   Those prefixes are the only thing that is shuffled; prefixes that nobody shares go at once.
4. Candidates share a prefix shingle and pass the length and positional filters. In a list of
   texts that share a shingle, all are first compared with one pivot, the text in which the
   shingle comes earliest; pairs that are in one component by then need no comparison. Further
   rounds take other pivots while lists stay long and pivots still link much. What is left over after
   that is joined in full, so no link between two components is lost.
5. A candidate pair must share enough prefix shingles and pass the suffix filter (counts of hash ranges
   of both sets bound the overlap), for which no text moves. Then it is verified on whole sets, once: a
   table keeps the pairs that were, and no later round takes them again.
6. Links become components by large and small stars.

A shingle whose bucket is far above the average is salted, so its list meets in no single task.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_SPACE, chunks, kept, mix, randoms, scratch, sealed, table, text_of, utf8, words, written
from .components import components

WORDS = 5
PERCENT = 80
#: Buckets of the counts that order shingles, and shingles that a task counts at once.
BUCKET_BITS = 20
BLOCK = 4_000_000
#: A list of one shingle is dealt to tasks in parts of about so many rows.
LIST_ROWS = 2000
#: Ranges of hashes that the suffix filter counts, a power of two.
RANGES = 64
#: Rounds with further pivots, while lists hold over so many pairs for each of their rows and the
#: round before has linked more than one in so many of those rows.
PIVOT_ROUNDS, PAIRS_A_ROW, ROWS_A_LINK = 6, 8, 50


# -- sets, in numpy -----------------------------------------------------------------------------


def shingles(raw: np.ndarray, at: np.ndarray, size: int = WORDS):
    """(hash, document) of all shingles; a text of fewer words has one, all of them."""
    h, _, _, first = words(raw, at, NOT_SPACE)
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - first[owner]
    left = n[owner] - place
    r = randoms(size, 20)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    x = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            x += np.where(left > j, padded[j : j + len(h)] * r[j], np.uint64(0))
        x = mix(x + np.minimum(n[owner], size).astype(np.uint64))
    keep = (left >= size) | (place == 0)
    return x[keep], owner[keep]


def sets(raw: np.ndarray, at: np.ndarray, size: int = WORDS):
    """Distinct shingles sorted by document and hash, the document of each, and set sizes."""
    x, owner = shingles(raw, at, size)
    by = np.lexsort((x, owner))
    x, owner = x[by], owner[by]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[new], owner[new]
    return x, owner, np.bincount(owner, minlength=len(at) - 1)


def signatures(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of each set, as int64; 0 for an empty one."""
    out = np.zeros(len(n), np.uint64)
    some = n > 0
    if len(x):
        with np.errstate(over="ignore"):
            begins = (np.cumsum(n) - n)[some]
            out[some] = mix(np.add.reduceat(mix(x ^ np.uint64(0xA0761D6478BD642F)), begins) + n[some].astype(np.uint64))
    return out.view(np.int64)


def first_seen(node: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which of the nodes a task meets for the first time."""
    out = np.zeros(len(node), bool)
    for i, s in enumerate(node.tolist()):
        if s not in seen:
            seen.add(s)
            out[i] = True
    return out


def buckets(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


# -- passes over the texts ----------------------------------------------------------------------


def survey(docs: DataFrame, size: int) -> DataFrame:
    """One row (0, doc_id, key, node, n) for each document and rows (1, bucket, null, null, count) of shingles."""

    def run(batches):
        import pyarrow as pa

        count, held, size_held, seen = np.zeros(1 << BUCKET_BITS, np.int64), [], 0, set()

        def flush() -> None:
            if held:
                u, c = np.unique(np.concatenate(held), return_counts=True)
                np.add.at(count, buckets(u[c > 1]), c[c > 1])
                held.clear()

        names = ["kind", "a", "key", "node", "n"]
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            node, n = [], []
            for _, _, b, off in chunks(raw, at):
                x, owner, sizes = sets(b, off, size)
                own = signatures(x, sizes)
                new = first_seen(own, seen)
                held.append(x[new[owner]])
                size_held += len(held[-1])
                if size_held > BLOCK:
                    flush()
                    size_held = 0
                node.append(own)
                n.append(sizes)
            if node:
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int8)), batch.column("doc_id"), batch.column("key"), pa.array(np.concatenate(node)), pa.array(np.concatenate(n).astype(np.int64))], names)
        flush()
        k = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(k), np.int8)), pa.array(k), pa.nulls(len(k), pa.int64()), pa.nulls(len(k), pa.int64()), pa.array(count[k])], names)

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    return keyed.mapInArrow(run, "kind byte, a long, key long, node long, n long")


def prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, salt, node, at): the prefix shingles of every set; ``at`` is place << 32 | set size.
    A set that a task has already given is not given again."""
    value = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        import pyarrow as pa

        common = value.value
        usual = common.mean() + 10 * np.sqrt(common.mean())
        parts = np.where(common > usual + LIST_ROWS, (common - usual) // LIST_ROWS + 1, 1)
        seen: set[int] = set()
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for _, _, b, off in chunks(raw, at):
                x, owner, n = sets(b, off, size)
                node = signatures(x, n)
                fresh = first_seen(node, seen) & (n > 0)
                keep = fresh[owner]
                x, owner = x[keep], owner[keep]
                n = np.where(fresh, n, 0)
                bucket = buckets(x)
                by = np.lexsort((x, common[bucket], owner))
                x, bucket = x[by], bucket[by]
                place = np.arange(len(x)) - (np.cumsum(n) - n)[owner]
                own = n[owner]
                first = place < own - (percent * own + 99) // 100 + 1
                x, bucket, own, place, of = x[first], bucket[first], own[first], place[first], node[owner[first]]
                salt = (of.view(np.uint64) % parts[bucket].astype(np.uint64)).astype(np.int32) + np.where(parts[bucket] > 1, 1, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(salt), pa.array(of), pa.array((place << 32) | own)], ["token", "salt", "node", "at"])

    return docs.mapInArrow(run, "token long, salt int, node long, at long")


# -- filters ------------------------------------------------------------------------------------


def size_of(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << 32) - 1))


def place_of(at: str) -> Column:
    return F.shiftright(F.col(at), 32)


def needed(n: Column, m: Column, percent: int) -> Column:
    """The overlap that sets of n and m must have."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def may_match(a: str, b: str, percent: int) -> Column:
    """The length and positional filters, of two ``at`` columns for one shared shingle."""
    n, m = size_of(a), size_of(b)
    rest = F.least(n - place_of(a), m - place_of(b))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (rest >= needed(n, m, percent))


# -- candidates, verification -------------------------------------------------------------------


def verify(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The (a, b) of pairs whose sets are similar enough."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                a, b = part.column("a").to_numpy(), part.column("b").to_numpy()
                known: dict[int, np.ndarray] = {}
                for ids, column in ((a, part.column("ta")), (b, part.column("tb"))):
                    new, where = np.unique(ids, return_index=True)
                    raw, at = utf8(column.take(pa.array(where)))
                    for row, end, by, off in chunks(raw, at):
                        x, _, n = sets(by, off, size)
                        known |= zip(new[row:end].tolist(), np.split(x, np.cumsum(n)[:-1]), strict=True)
                ok = np.zeros(len(a), bool)
                for i, (p, q) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
                    x, y = known[p], known[q]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    one = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    two = one.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return two.mapInArrow(run, "a long, b long")


def ranges(texts: DataFrame, size: int) -> DataFrame:
    """(node, counts) of texts (node, text): how many shingles of the set are in each of RANGES equal
    ranges of hashes. A count that doesn't fit is the largest that does, which brings no counts apart."""
    shift = np.uint64(64 - (RANGES - 1).bit_length())

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            raw, at = utf8(batch.column("text"))
            for row, end, by, off in chunks(raw, at):
                x, owner, n = sets(by, off, size)
                got = np.bincount(owner * RANGES + (x >> shift).astype(np.int64), minlength=len(n) * RANGES)
                cut = pa.array(np.arange(len(n) + 1) * RANGES, pa.int32())
                counts = pa.ListArray.from_arrays(cut, pa.array(np.minimum(got, 32767).astype(np.int16)))
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(row, end - row), counts], ["node", "counts"])

    return texts.mapInArrow(run, "node long, counts array<smallint>")


def plausible(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs that share enough prefix shingles and pass the suffix filter. Sets that
    overlap enough differ in few shingles, so all but that many of the prefix that ends first are in
    the other prefix too, and the counts of hash ranges are not further apart than the shingles
    that only one set has. grams: node, n (set size), tokens (its prefix shingles that any
    other set has in its prefix), counts (of its hash ranges)."""
    side = lambda x: grams.select(F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "tokens", "counts")))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    n, m = F.col("n_a"), F.col("n_b")
    least = needed(n, m, percent) - F.ceil(F.greatest(n, m) * F.lit(percent) / 100 - F.lit(1e-9)) + 1
    apart = F.aggregate(F.zip_with("counts_a", "counts_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    near = (F.size(F.array_intersect("tokens_a", "tokens_b")) >= least) & (apart <= n + m - 2 * needed(n, m, percent))
    return both.where(near).select("a", "b")


def candidate_texts(docs: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of one document for each candidate node."""
    no_id = F.lit(-(1 << 63)).cast("long")
    keep = nodes.select(F.col("node").alias("k"))
    one = found.join(keep, F.col("node") == F.col("k"), "left_semi").groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", no_id).alias("i"), F.col("key").alias("j"))).alias("d"))
    keyed = docs.select(F.coalesce("doc_id", no_id).alias("i"), F.xxhash64("text").alias("j"), "text")
    # rows that are equal in id and text are one here; the join has dealt them by both already
    return keyed.join(one.select("node", "d.i", "d.j"), ["i", "j"]).groupBy("i", "j", "node").agg(F.first("text").alias("text")).select("node", "text")


def merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, comp) after the links (a, b) between nodes."""
    c = comp.select(F.col("node").alias("k"), "comp")
    edges = links.join(c, F.col("a") == F.col("k")).select("b", F.col("comp").alias("u")).join(c, F.col("b") == F.col("k")).select("u", F.col("comp").alias("v"))
    roots = components(edges).select(F.col("node").alias("k"), "root")
    return written(comp.join(roots, F.col("comp") == F.col("k"), "left").select("node", F.coalesce("root", "comp").alias("comp")), "comp")


def similar_groups(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, key (xxhash64 of the text), n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Null texts and texts without words have no shingles and link with nothing; their component is
    their own doc_id. Rows with equal texts are linked like any others. A null doc_id is in
    its texts' component but never names it, unless nothing else is in it. Other columns are not read.
    """
    rows = text_of(docs)
    with scratch():
        seen = kept(survey(rows, size), "survey")
        found = seen.where("kind = 0").select(F.col("a").alias("doc_id"), "key", "node", "n")
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for r in seen.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).toLocalIterator():  # 2^BUCKET_BITS at most
            counts[r[0]] = r[1]

        group = W.partitionBy("token", "salt")
        listed = prefixes(rows, counts, size, percent).withColumns({"lo": F.min("node").over(group), "hi": F.max("node").over(group)})
        lists = written(listed.where("lo <> hi or salt > 0").select("token", "node", "at").distinct(), "lists")
        nodes = written(lists.select("node").distinct(), "nodes")
        texts = written(candidate_texts(rows, found, nodes), "texts")
        grams = lists.groupBy("node").agg(F.max(size_of("at")).alias("n"), F.collect_list("token").alias("tokens"))
        grams = written(grams.join(ranges(texts, size), "node"), "grams")
        comp = nodes.select("node", F.col("node").alias("comp"))
        verified: list[DataFrame] = []

        def linked(pairs: DataFrame) -> DataFrame:
            """The pairs that are links, without those that an earlier round has verified."""
            new = pairs.join(reduce(DataFrame.unionByName, verified), ["a", "b"], "left_anti") if verified else pairs
            new = written(plausible(new, grams, percent), "pairs")
            verified.append(new)
            return written(verify(new, texts, size, percent), "links")

        for turn in range(PIVOT_ROUNDS):
            own = lists.join(comp, "node") if turn else lists.withColumn("comp", F.col("node"))
            order = F.struct("at", "node", "comp") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)).alias("x"), "at", "node", "comp")
            own = own.withColumn("p", order)
            pivots = own.groupBy("token").agg(F.count("*").alias("rows"), F.min("p").alias("p"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
            if turn:
                pivots = written(pivots, "pivots")
                total = pivots.agg(F.sum("rows"), F.sum(F.col("rows") * F.col("rows") / 2)).first()
                if not total[0] or total[1] <= PAIRS_A_ROW * total[0] or links.count() * ROWS_A_LINK < total[0]:
                    break
            p = pivots.select(F.col("token").alias("t"), F.col("p.node").alias("pn"), F.col("p.at").alias("pa"), F.col("p.comp").alias("pc"))
            near = own.join(p, F.col("token") == F.col("t")).where((F.col("comp") != F.col("pc")) & may_match("at", "pa", percent))
            pairs = near.select(F.least("node", "pn").alias("a"), F.greatest("node", "pn").alias("b")).distinct()
            links = linked(pairs)
            comp = merge(comp, links)

        # The rest: lists that still hold two components, without texts that can't match in them.
        own = lists.join(comp, "node")
        bounds = own.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min(size_of("at")).alias("least")).where("lo <> hi").select(F.col("token").alias("t"), "least")
        n = size_of("at")
        partner = F.greatest(F.col("least"), F.ceil(n * F.lit(percent) / 100 - 1e-9))
        able = written(own.join(bounds, F.col("token") == F.col("t")).where(n - place_of("at") >= needed(n, partner, percent)).select("token", "node", "at", "comp"), "able")
        other = able.select(F.col("token").alias("t"), F.col("node").alias("b"), F.col("at").alias("bt"), F.col("comp").alias("bc"))
        both = (F.col("token") == F.col("t")) & (F.col("node") < F.col("b")) & (F.col("comp") != F.col("bc")) & may_match("at", "bt", percent)
        pairs = able.join(other, both).select(F.col("node").alias("a"), "b").distinct()
        comp = merge(comp, linked(pairs))

        least = found.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("d"))
        c = comp.select(F.col("node").alias("k"), "comp")
        placed = least.join(c, F.col("node") == F.col("k"), "left").select("node", "d", F.coalesce("comp", "node").alias("comp"))
        names = placed.groupBy("comp").agg(F.min("d").alias("component_id"))
        ids = kept(placed.join(names, "comp").select(F.col("node").alias("k"), "component_id"), "components")
    out = found.join(ids, (F.col("node") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each group of similar texts, the one with the smallest doc_id;
    documents without shingles (null and empty texts) stay. Several rows with that doc_id in one
    group all stay. All columns stay as they are, whatever they are called."""
    docs, back = sealed(docs, "doc_id", "text")
    names = similar_groups(docs.select("doc_id", "text"), size, percent)
    drop = names.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_d"), F.col("key").alias("_j")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_j"))
    return back(docs.join(drop, same, "left_anti"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).drop("key")
