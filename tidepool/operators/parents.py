"""Uniques and their more abundant parents: denoising by near parents, chimeras of two parents.

Both look for parents within a sample, of which one may hold a third of all uniques, and neither compares
all pairs. Near parents of short sequences are found by walks over the tree of children's beginnings, those of long
ones by pieces of sequences, of which each child takes its rarest; the parents that share the longest beginning or end
with a child are its neighbours in sorted order.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import kept, scratch, written
from .near_tree import SHORT, best_parents

#: Lengths that pieces may have; below LEAST_PIECE, deletions are tried first, if a sequence has so few variants.
PIECES, LEAST_PIECE, MOST_VARIANTS = (12, 8, 6, 4, 3, 2, 1), 6, 64
#: Children of one tree, in more than ``TREES`` trees up to ``LARGE_TREE``; parents that one task holds.
TREE, TREES, LARGE_TREE, HELD = 16_384, 256, 131_072, 250_000


def variants(length: int, distance: int) -> int:
    """Sequences that a sequence can become by deleting up to so many letters, at most."""
    return sum(math.comb(length, i) for i in range(min(distance, length) + 1))


def piece_length(length: Column, distance: int) -> Column:
    """How a child of that length is looked up: by pieces of so many letters; -1: by deletions; 0: too short
    for either, by its sample."""
    whole = F.floor(length / (distance + 1))
    longest = -1  # for deletions
    while variants(longest + 1 + distance, distance) <= MOST_VARIANTS and longest < 64:
        longest += 1
    out = F.when(F.lit(False), 0)
    for p in PIECES:
        if p == LEAST_PIECE:
            out = out.when(whole >= p, p).when(length <= longest, -1)
        else:
            out = out.when(whole >= p, p)
    return out.otherwise(0).cast("int")


def deletions(seq: str, distance: int) -> Column:
    """All that is left of a sequence without up to ``distance`` of its letters."""
    shorter = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda j: F.concat(F.left(s, j - 1), F.substring(s, j + 1, F.length(s))))
    level = lambda ss: F.array_distinct(F.flatten(F.transform(F.filter(ss, lambda s: F.length(s) > 0), shorter)))
    levels = F.aggregate(F.sequence(F.lit(1), F.lit(distance)), F.array(F.array(F.col(seq))), lambda done, _: F.concat(done, F.array(level(F.element_at(done, -1)))))
    return F.array_distinct(F.flatten(levels))


def near_pairs(children: DataFrame, parents: DataFrame, distance: int, ratio: float = 1.0) -> DataFrame:
    """(sample_id, seq, n, parent, pn, d): pairs of a sample with a more abundant parent (``ratio`` times, if given) at a Levenshtein
    distance of 1 to ``distance``. Null sequences are no one's parents or children.

    So many edits leave all but ``distance`` of a child's disjoint pieces as they are, so among any
    distance + 1 of them is one that the parent has too, no farther off than the distance. Pieces
    have a fixed length, and a child is looked up by the distance + 1 that fewest parents have. A parent
    gives each of its pieces once. Short sequences that have few letters to lose meet where both
    have lost some.
    """
    with scratch():
        u = children.where(F.col("seq").isNotNull()).select("sample_id", "seq", "n", piece_length(F.length("seq"), distance).alias("size"))
        own = parents.where(F.col("seq").isNotNull()).select("sample_id", F.col("seq").alias("parent"), F.col("n").alias("pn"))
        around = F.sequence(F.greatest(F.length("parent") - distance, F.lit(0)), F.length("parent") + distance)
        sizes = F.array_distinct(F.transform(around, lambda x: piece_length(x, distance)))
        sized = own.withColumn("size", F.explode(sizes))
        used = u.select("sample_id", "size").distinct()
        sized = sized.join(used, ["sample_id", "size"], "left_semi")
        # pieces at every place of a parent, under the numbers of the child's pieces that may come to lie there
        places = F.when(F.length("parent") >= F.col("size"), F.sequence(F.lit(1), F.length("parent") - F.col("size") + 1)).otherwise(F.array().cast("array<int>"))
        given = sized.where("size > 0").select("sample_id", "size", "parent", "pn", F.explode(places).alias("at"))
        low, high = F.greatest(F.ceil((F.col("at") - 1 - distance) / F.col("size")), F.lit(0)).cast("int"), F.floor((F.col("at") - 1 + distance) / F.col("size")).cast("int")
        given = given.where(low <= high).select("*", F.explode(F.sequence(low, high)).alias("i"))
        given = written(given.select("sample_id", "size", "i", F.xxhash64(F.expr("substring(parent, at, size)")).alias("piece"), "parent", "pn"), "pieces")
        key = ["sample_id", "size", "i", "piece"]
        whole = F.sequence(F.lit(0), F.floor(F.length("seq") / F.col("size")).cast("int") - 1)
        asked = u.where("size > 0").select("*", F.explode(whole).alias("i")).withColumn("piece", F.xxhash64(F.expr("substring(seq, i * size + 1, size)")))
        # pieces of few letters are common, whichever they are: the first ones do
        early = asked.where((F.col("size") < LEAST_PIECE) & (F.col("i") <= distance))
        often = given.where(F.col("size") >= LEAST_PIECE).groupBy(*key).agg(F.count("*").alias("k"))
        found = asked.where(F.col("size") >= LEAST_PIECE).join(often, key, "left").withColumn("k", F.coalesce("k", F.lit(0)))
        rarest = found.groupBy("sample_id", "seq", "n", "size").agg(F.slice(F.array_sort(F.collect_list(F.struct("k", "i", "piece"))), 1, distance + 1).alias("r"))
        rare = rarest.select("sample_id", "seq", "n", "size", F.explode("r").alias("r")).where("r.k > 0").select("sample_id", "seq", "n", "size", "r.i", "r.piece")
        chosen = rare.unionByName(early.select(*rare.columns))
        by_piece = chosen.join(given, key).select("sample_id", "seq", "n", "parent", "pn")
        lost = lambda df, c: df.where("size = -1").withColumn("left", F.explode(deletions(c, distance)))
        by_loss = lost(u, "seq").drop("size").join(lost(sized, "parent").drop("size"), ["sample_id", "left"]).select("sample_id", "seq", "n", "parent", "pn")
        by_sample = u.where("size = 0").drop("size").join(sized.where("size = 0").drop("size"), "sample_id").select("sample_id", "seq", "n", "parent", "pn")
        pairs = by_piece.unionByName(by_loss).unionByName(by_sample).where((F.col("pn") > F.col("n")) & (F.col("pn") >= F.col("n") * (ratio * (1 - 1e-9))) & (F.col("seq") != F.col("parent")) & (F.abs(F.length("seq") - F.length("parent")) <= distance))
        # candidates are verified where they meet, so that only pairs move on, and each once
        return kept(pairs.withColumn("d", F.levenshtein("seq", "parent", distance)).where(F.col("d") >= 0).distinct(), "near")


def best_short_parents(children: DataFrame, parents: DataFrame, most: list[float]) -> DataFrame:
    """(sample_id, seq, into, pn, d): the most abundant parent of each child at a distance d from 1 on with n / pn <= most[d],
    then the nearest, then the first. Sequences have up to ``SHORT`` letters; rows without a sample, sequence or n are left out.

    Children are cut into ranges of a sorted order, whose tree each is walked for all parents of the sample. If
    parents are many, they are dealt to several tasks by hash, and a child may come up once for each.
    """
    kind = children.schema["sample_id"].dataType.simpleString()
    whole = "sample_id IS NOT NULL AND seq IS NOT NULL AND n IS NOT NULL"
    with scratch():
        rows = lambda df: df.where(whole).select("sample_id", "seq", F.col("n").cast("double").alias("n"))
        many, deals = rows(children).count(), math.ceil(rows(parents).count() / HELD)
        if not many or not deals:
            return children.sparkSession.createDataFrame([], f"sample_id {kind}, seq string, into string, pn double, d int")
        trees = max(math.ceil(many / LARGE_TREE), min(TREES, math.ceil(many / TREE)))
        ranges = written(rows(children).repartitionByRange(trees, "sample_id", "seq").withColumn("_p", F.spark_partition_id()), "ranges")
        places = written(ranges.groupBy("_p", "sample_id").agg(F.count("*").alias("rows")), "places").select("_p", "sample_id")
        dealt = rows(parents).groupBy("sample_id", F.pmod(F.xxhash64("seq"), F.lit(deals)).cast("int").alias("_deal")).agg(F.collect_list(F.struct("seq", "n")).alias("all"))
        key = ["_p", "sample_id", "_deal"]
        tasks = 3 * deals * places.count()  # so that few groups meet in one
        asked = ranges.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).repartition(tasks, *key)
        given = dealt.join(places, "sample_id").select(*key, F.col("all.seq").alias("parents"), F.col("all.n").alias("pn")).repartition(tasks, *key)

        def best(own: pd.DataFrame, able: pd.DataFrame) -> pd.DataFrame:
            if not len(own) or not len(able):
                return pd.DataFrame(columns=["sample_id", "seq", "into", "pn", "d"])
            p, pn = able["parents"].iloc[0], able["pn"].iloc[0]
            child, parent, d = best_parents(own["seq"], own["n"], p, pn, np.array(most))
            took = own.iloc[child]
            return pd.DataFrame({"sample_id": took["sample_id"].to_numpy(), "seq": took["seq"].to_numpy(), "into": np.asarray(p, object)[parent], "pn": np.asarray(pn)[parent], "d": d})

        got = asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInPandas(best, f"sample_id {kind}, seq string, into string, pn double, d int")
        return kept(got, "short")


def denoise(uniques: DataFrame, alpha: float = 2.0, base: float = 1.0, max_distance: int | None = None) -> DataFrame:
    """sample_id, seq, n after UNOISE2's rule in one pass: a unique joins the most abundant parent at a
    distance d whose abundance makes n / parent <= 2^-(alpha d + base), if there is one.

    The largest and smallest abundances bound d. Pairs of short sequences are found by walks over trees. Pairs with one
    of more than ``SHORT`` letters are looked for at each d by itself, among children that long parents can be near to and that are rare enough
    for it, and abundant parents, so far pairs are sought for few sequences. ``max_distance`` leaves out farther parents, for
    callers who want that.
    """
    with scratch():
        parts = int(uniques.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many tasks, however few bytes there are
        u = written(uniques.select("sample_id", "seq", "n").repartition(parts, "sample_id", "seq"), "uniques")
        least, most, longest = u.agg(F.min("n"), F.max("n"), F.max(F.length("seq"))).first()
        far = max(0, math.floor((math.log2(most / least) - base) / alpha + 1e-9)) if least else 0
        far = far if max_distance is None else min(far, max_distance)
        if not far or longest is None:
            return kept(u, "denoised")
        short = u.where(F.length("seq") <= SHORT)
        able = lambda df, d: df.where(F.col("n") >= least * 2 ** (alpha * d + base) * (1 - 1e-9))
        rare = lambda df, d: df.where(F.col("n") <= most / 2 ** (alpha * d + base) * (1 + 1e-9))
        found = [best_short_parents(rare(short, 1), able(short, 1), [2.0 ** -(alpha * d + base) for d in range(far + 1)])]
        for d in range(1, far + 1) if longest > SHORT else ():
            pairs = near_pairs(rare(u.where(F.length("seq") + d > SHORT), d), able(u, d), d, 2 ** (alpha * d + base)).where(F.col("d") == d)
            pairs = pairs.where(F.col("n") / F.col("pn") <= F.pow(F.lit(2.0), -(F.col("d") * alpha + base)))
            found.append(pairs.select("sample_id", "seq", F.col("parent").alias("into"), F.col("pn").cast("double").alias("pn"), "d"))
        near = reduce(DataFrame.unionByName, found)
        best = near.groupBy("sample_id", "seq").agg(F.min_by("into", F.struct(-F.col("pn"), "d", "into")).alias("into"))
        joined = u.join(best, ["sample_id", "seq"], "left")
        return kept(joined.groupBy("sample_id", F.coalesce("into", "seq").alias("seq")).agg(F.sum("n").alias("n")), "denoised")


def common(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Levels:
    """The sequences of a walk that later ones may still have as nearest parent: of each abundance the last one,
    unless one at least as abundant came after it. Abundances fall from the first to the last."""

    def __init__(self):
        self.minus: list[float] = []
        self.seqs: list[str] = []

    def push(self, seq: str, n: float) -> None:
        while self.minus and self.minus[-1] >= -n:
            self.minus.pop()
            self.seqs.pop()
        self.minus.append(-n)
        self.seqs.append(seq)

    def nearest(self, n: float) -> str | None:
        """The last sequence with that abundance or more."""
        i = bisect_right(self.minus, -n)
        return self.seqs[i - 1] if i else None


def walk(rows, before=(), ratio: float | None = None):
    """rows (sample, key, n) in one direction of their order, after ``before``, those that came earlier and
    matter. Gives each row's common beginning with the nearest parent (-1: none) if there is a ratio, and
    returns the levels at the end. Rows with one key aren't each other's parents."""
    levels, sample, out, waiting = Levels(), None, [], []
    for s, k, n in before:
        sample = s
        levels.push(k, n)
    last = None
    for s, k, n in rows:
        if s != sample:
            levels, sample, waiting = Levels(), s, []
        elif k != last:
            for x in waiting:
                levels.push(last, x)
            waiting = []
        last = k
        waiting.append(n)
        if ratio is not None:
            near = levels.nearest(ratio * n)
            out.append(-1 if near is None else common(k, near))
    for x in waiting:
        levels.push(last, x)
    return out, (sample, levels)


def longest_shared(rows: DataFrame, ratio: float) -> DataFrame:
    """(sample_id, key, n, shared): length of the longest common beginning of each key with one of at least
    ``ratio`` times its abundance in its sample; rows without such a parent are left out.

    Rows (sample_id, key, n) are sorted in ranges. A range needs of those before and behind it only the levels
    of abundance that are still in sight at its border, which may come from ranges farther off.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["sample_id"].dataType.simpleString()
    with scratch():
        ranges = written(rows.where("sample_id IS NOT NULL AND key IS NOT NULL AND n IS NOT NULL").repartitionByRange(parts, "sample_id", "key").withColumn("_p", F.spark_partition_id()), "ranges")
        schema = f"_p int, back boolean, sample_id {kind}, key string, n double"

        def tuples(pdf: pd.DataFrame):
            return sorted(zip(pdf["sample_id"], pdf["key"], pdf["n"], strict=True))

        def ends(pdf: pd.DataFrame) -> pd.DataFrame:
            own, p = tuples(pdf), int(pdf["_p"].iloc[0])
            out = []
            for back in (False, True):
                _, (sample, levels) = walk(reversed(own) if back else own)
                out += [(p, back, sample, k, -m) for k, m in zip(levels.seqs, levels.minus, strict=True)]
            return pd.DataFrame(out, columns=["_p", "back", "sample_id", "key", "n"])

        border = written(ranges.groupBy("_p").applyInPandas(ends, schema), "border")
        # of each range: the sample at either end, and its largest abundance there
        seen = {(r["_p"], r["back"]): (r["s"], r["n"]) for r in border.groupBy("_p", "back").agg(F.first("sample_id").alias("s"), F.max("n").alias("n")).collect()}

        def sent(batches):
            for pdf in batches:
                out = []
                for p, back, s, k, n in pdf.itertuples(index=False):
                    q = p + (-1 if back else 1)
                    while 0 <= q < parts:
                        if (q, back) in seen:
                            if seen[q, not back][0] != s:
                                break
                            out.append((q, back, s, k, n))
                            if seen[q, back][0] != s or seen[q, back][1] >= n:
                                break
                        q += -1 if back else 1
                yield pd.DataFrame(out, columns=["_p", "back", "sample_id", "key", "n"])

        def shared(pdf: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
            own = tuples(pdf)
            outside = {b: sorted(zip(g["sample_id"], g["key"], g["n"], strict=True), reverse=bool(b)) for b, g in near.groupby("back")}
            forth, _ = walk(own, outside.get(False, ()), ratio)
            back, _ = walk(reversed(own), outside.get(True, ()), ratio)
            out = [(s, k, n, m) for (s, k, n), a, b in zip(own, forth, reversed(back), strict=True) if (m := max(a, b)) >= 0]
            return pd.DataFrame(out, columns=["sample_id", "key", "n", "shared"])

        outside = border.mapInPandas(sent, schema)
        got = ranges.groupBy("_p").cogroup(outside.groupBy("_p")).applyInPandas(lambda a, b: shared(a, b) if len(a) else pd.DataFrame(columns=["sample_id", "key", "n", "shared"]), f"sample_id {kind}, key string, n double, shared int")
        return kept(got, "shared")


def chimeras(uniques: DataFrame, ratio: float = 2.0) -> DataFrame:
    """sample_id, seq, n, chimera: whether parents of ratio times the abundance or more make up the
    sequence: the longest common beginning with one and the longest common end with one
    add up to its length, and neither equals it.

    Sequences without a letter, nulls, and rows without an abundance are no chimeras. The longest common
    beginning is one with a neighbour in sorted order, the longest common end one with a neighbour among the
    reversed sequences, so no pairs are made, however many uniques share one half.
    """
    with scratch():
        u = written(uniques.select("sample_id", "seq", "n"), "uniques")
        rows = lambda key: u.select("sample_id", key.alias("key"), F.col("n").cast("double").alias("n"))
        begin, end = longest_shared(rows(F.col("seq")), ratio), longest_shared(rows(F.reverse("seq")), ratio)
        zero = F.lit(None).cast("int")
        sides = begin.select("sample_id", F.col("key").alias("seq"), "n", F.col("shared").alias("a"), zero.alias("b")).unionByName(end.select("sample_id", F.reverse("key").alias("seq"), "n", zero.alias("a"), F.col("shared").alias("b")))
        made = sides.groupBy("sample_id", "seq", "n").agg(F.max("a").alias("a"), F.max("b").alias("b")).where((F.col("a") + F.col("b") >= F.length("seq")) & (F.length("seq") > 0))
        flags = made.select(F.col("sample_id").alias("_s"), F.col("seq").alias("_q"), F.col("n").alias("_n"))
        same = (F.col("sample_id") == F.col("_s")) & (F.col("seq") == F.col("_q")) & (F.col("n").cast("double") == F.col("_n"))
        return kept(u.join(flags, same, "left").select("sample_id", "seq", "n", F.col("_q").isNotNull().alias("chimera")), "chimeras")


def remove_chimeras(uniques: DataFrame, ratio: float = 2.0) -> DataFrame:
    return chimeras(uniques, ratio).where(~F.col("chimera")).drop("chimera")
