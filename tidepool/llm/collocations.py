"""Phrase collocations by best-first growth of prefixes.

Phrases of two and three words are scored by their worst cut: f(phrase)^2 / (f(first part) f(rest)).
Counts are exact and come from scans of all texts, of which the first counts words and the second
pairs of words that are frequent enough themselves. A third word is not looked for behind every pair:
as f(phrase) is at most f(rest), no phrase that grows from the pair (u, v) scores above
f(u, v) / f(u), and the count of (u, v) also bounds how much of a pair (v, w) it can cover. Both
bounds give each pair a priority, the highest threshold at which its growth can matter. In rounds, each
language's frontier is expanded down to a lower threshold, until the phrases that survive at it are
as many as wanted: whatever was not expanded then scores less than all of them, ties included.

Scans hash words to 64 bits and keep phrases as the hashes of their words. What a scan may skip is told by
bit tables of a fixed size (a set bit may be wrong, an unset one is not); joins decide exactly.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import chunks, kept, lookup, mix, scratch, table, utf8, words, written

LEAST, TOP = 10, 2000
#: Bits of a table that a scan gets: 2 MB, however many phrases are in it.
BITS = 1 << 24
#: Different phrases that a task counts before it passes the counts on, and rows in a batch of those.
HELD, BATCH_ROWS = 400_000, 40_000
#: Bytes of text that are looked at together; a longer text is taken whole.
CHUNK_BYTES = 1_000_000
#: A round goes down to the pair that is so many times further down the language's list than the one before.
GROWTH = 4
#: Groups that equal last places of a language are dealt to.
SALTS = 64

BREAKS = lookup(*[(ord(c), ord(c)) for c in ".,;:!?"], (0x0A, 0x0D))
WORD = ~(BREAKS | lookup((0x20, 0x20), (0x09, 0x09)))
FACTOR = np.uint64(0xD6E8FEB86659FD93)
PARTS = "abc"


def _columns(k: int) -> list[str]:
    return ["lang", *PARTS[:k]]


def _key(lang: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """A number for each (hash of a language, hashes of words)."""
    with np.errstate(over="ignore"):
        k = lang
        for p in parts:
            k = mix(k * FACTOR + p)
        return k


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class _Langs:
    """Numbers of the languages that a task has met, and their hashes."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.hashes = np.zeros(0, np.uint64)

    def numbers(self, column) -> np.ndarray:
        got = column.dictionary_encode()
        own = []
        for x in got.dictionary.to_pylist():
            if x not in self.names:
                self.names[x] = len(self.names)
                self.hashes = np.append(self.hashes, np.uint64(_lang_hash(x)))
            own.append(self.names[x])
        return np.array(own, np.int64)[got.indices.to_numpy(zero_copy_only=False)] if own else np.zeros(0, np.int64)

    def strings(self, numbers: np.ndarray):
        import pyarrow as pa

        return pa.DictionaryArray.from_arrays(pa.array(numbers.astype(np.int32)), pa.array(list(self.names), pa.string())).cast(pa.string())


def _reduced(key: np.ndarray, cols: list[np.ndarray], n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of n by cols. Rows are ordered by key; equal keys of unequal cols only leave a sum in two parts."""
    order = np.argsort(key)
    cols = [c[order] for c in cols]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    first = np.flatnonzero(new)
    return [c[first] for c in cols], np.add.reduceat(n[order], first) if len(first) else n[:0]


class _Sums:
    """Counts by (language, hashes) that a task passes on when it holds too many."""

    def __init__(self, langs: _Langs, k: int):
        self.langs, self.k, self.held, self.size = langs, k, [], 0

    def add(self, lang: np.ndarray, parts: list[np.ndarray]):
        self.held.append(self._sum([lang, *parts], np.ones(len(lang), np.int64)))
        self.size += len(self.held[-1][1])
        if self.size > HELD:
            yield from self.flush(HELD // 2)

    def _sum(self, cols, n):
        return _reduced(_key(self.langs.hashes[cols[0]], cols[1:]), cols, n)

    def flush(self, most: int = 0):
        """Add up; what is then more than ``most`` is passed on."""
        import pyarrow as pa

        if not self.held:
            return
        cols, n = self._sum([np.concatenate(c) for c in zip(*[x for x, _ in self.held], strict=True)], np.concatenate([n for _, n in self.held]))
        self.held, self.size = [(cols, n)], len(n)
        if len(n) > most:
            self.held, self.size = [], 0
            for i in range(0, len(n), BATCH_ROWS):
                some = slice(i, i + BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([self.langs.strings(cols[0][some]), *[pa.array(c[some].view(np.int64)) for c in cols[1:]], pa.array(n[some])], [*_columns(self.k), "n"])


def _texts(batches, langs: _Langs):
    """Of each chunk of texts: (language of each word, its hash, whether the next word is in the same piece,
    lowered bytes, starts, ends)."""
    for batch in batches:
        of = langs.numbers(batch.column("_lang"))
        raw, at = utf8(batch.column("_text"))
        for row, end, part, off in chunks(raw, at, CHUNK_BYTES):
            h, starts, ends, first = words(part, off, WORD)
            if not len(h):
                continue
            cuts = np.concatenate([[0], np.cumsum(BREAKS[part])])
            joined = np.zeros(len(h), bool)
            joined[:-1] = cuts[starts[1:]] == cuts[ends[:-1]]
            last = first[1:][np.diff(first) > 0] - 1
            joined[last] = False
            yield np.repeat(of[row:end], np.diff(first)), h, joined, part, starts, ends


def _scan(docs: DataFrame, k: int, wanted=None) -> DataFrame:
    """(lang, hashes of k words, n): phrases of k words, counted. ``wanted`` gets the keys of all
    phrases of k - 1 words and says by (those of the first ones, those of the last ones) which count."""

    def run(batches):
        langs = _Langs()
        sums = _Sums(langs, k)
        for lang, h, joined, *_ in _texts(batches, langs):
            yield from sums.add(*_phrases(langs, lang, h, joined, k, wanted))
        yield from sums.flush()

    out = docs.mapInArrow(run, ", ".join([f"{c} {'string' if c == 'lang' else 'long'}" for c in [*_columns(k), "n"]]))
    # tasks have added up what they could, so rows go to their keys' tasks at once and are added up there
    return out.repartition(*_columns(k)).groupBy(*_columns(k)).agg(F.sum("n").alias("n"))


def _starts(joined: np.ndarray, k: int) -> np.ndarray:
    """Places where k words in a row are in one piece."""
    n = len(joined) - k + 1
    ok = np.ones(max(n, 0), bool)
    for j in range(k - 1):
        ok &= joined[j : j + n]
    return np.flatnonzero(ok)


def _phrases(langs, lang, h, joined, k, wanted):
    at = _starts(joined, k)
    if wanted is not None and len(at):
        shorter = _key(langs.hashes[lang[: len(h) - k + 2]], [h[j : len(h) - k + 2 + j] for j in range(k - 1)])
        at = at[wanted(shorter, at)]
    return lang[at], [h[at + j] for j in range(k)]


def bit_table(phrases: DataFrame, k: int):
    """A broadcast table of BITS bits with those of the phrases' keys set."""

    def run(batches):
        import pyarrow as pa

        bits, langs = np.zeros(BITS // 64, np.uint64), _Langs()
        for batch in batches:
            number = langs.numbers(batch.column("lang"))
            key = _key(langs.hashes[number], [batch.column(c).to_numpy().view(np.uint64) for c in PARTS[:k]]) % np.uint64(BITS)
            np.bitwise_or.at(bits, (key >> np.uint64(6)).astype(np.int64), np.uint64(1) << (key & np.uint64(63)))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bits[some].view(np.int64))], ["slot", "bits"])

    rows = phrases.select(*_columns(k)).mapInArrow(run, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # BITS / 64 rows at most
    out = np.zeros(BITS // 64, np.uint64)
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return phrases.sparkSession.sparkContext.broadcast(out)


def _has(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    key = key % np.uint64(BITS)
    return (bits[(key >> np.uint64(6)).astype(np.int64)] >> (key & np.uint64(63))) & np.uint64(1) == 1


def cut_score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (left right)) without rounding, for counts below 10^15."""
    d = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"({d(a)} * {d(a)} * 1000000) div ({d(left)} * {d(right)})")


def count_words(docs: DataFrame, least: int) -> DataFrame:
    """(lang, a, n): words that occur ``least`` times or more; a is null for all others of a language together."""
    return _scan(docs, 1).groupBy("lang", F.when(F.col("n") >= least, F.col("a")).alias("a")).agg(F.sum("n").alias("n"))


def count_pairs(docs: DataFrame, frequent: DataFrame, least: int) -> DataFrame:
    """(lang, a, b, n, l, r, score, bound): pairs of frequent words that occur ``least`` times or more.
    ``bound`` is the highest score of a longer phrase that begins with the pair."""
    bits = bit_table(frequent, 1)
    pairs = _scan(docs, 2, lambda key, at: (ok := _has(bits.value, key))[at] & ok[at + 1]).where(F.col("n") >= least)
    one = lambda c, n: frequent.select("lang", F.col("a").alias(c), F.col("n").alias(n))
    pairs = pairs.join(one("a", "l"), ["lang", "a"]).join(one("b", "r"), ["lang", "b"])
    return pairs.select("lang", "a", "b", "n", "l", "r", cut_score("n", "l", "r").alias("score"), F.expr("(cast(n as decimal(15, 0)) * 1000000) div l").alias("bound"))


def grow(docs: DataFrame, pairs: DataFrame, expand: DataFrame, frequent_pairs, least: int) -> DataFrame:
    """(lang, a, b, c, n, l, r, score): phrases of three words that begin with one of the pairs of ``expand``."""
    bits = bit_table(expand, 2)
    found = _scan(docs, 3, lambda key, at: _has(bits.value, key)[at] & _has(frequent_pairs.value, key)[at + 1]).where(F.col("n") >= least)
    first = expand.select("lang", "a", "b", F.col("n").alias("_ab"), F.col("l").alias("_a"))
    last = pairs.select("lang", F.col("a").alias("b"), F.col("b").alias("c"), F.col("n").alias("_bc"), F.col("r").alias("_c"))
    both = found.join(first, ["lang", "a", "b"]).join(last, ["lang", "b", "c"])
    both = both.withColumns({"_1": cut_score("n", "_a", "_bc"), "_2": cut_score("n", "_ab", "_c")})
    early = F.col("_1") <= F.col("_2")
    return both.select("lang", "a", "b", "c", "n", F.when(early, F.col("_a")).otherwise(F.col("_ab")).alias("l"), F.when(early, F.col("_bc")).otherwise(F.col("_c")).alias("r"), F.least("_1", "_2").alias("score"))


def thresholds(pairs: DataFrame, place: int) -> DataFrame:
    """(lang, theta): the score of the pair at that place of each language, 0 where there are fewer. The
    thousand that holds it is found first, and then the score in it, so that no task has more than a thousand
    counts of a language."""
    thousand = F.expr("score div 1000")
    coarse = pairs.groupBy("lang", thousand.alias("_t")).agg(F.count("*").alias("k"))
    upto = lambda c: F.sum("k").over(W.partitionBy("lang").orderBy(F.desc(c)))
    holds = coarse.withColumn("_upto", upto("_t")).where((F.col("_upto") >= place) & (F.col("_upto") - F.col("k") < place))
    holds = holds.select("lang", "_t", (F.col("_upto") - F.col("k")).alias("_before"))
    fine = pairs.withColumn("_t", thousand).join(holds, ["lang", "_t"]).groupBy("lang", "_before", "score").agg(F.count("*").alias("k"))
    found = fine.withColumn("_k", F.col("_before") + upto("score")).where(F.col("_k") >= place).groupBy("lang").agg(F.max("score").alias("theta"))
    return coarse.select("lang").distinct().join(found, "lang", "left").select("lang", F.coalesce("theta", F.lit(0)).alias("theta"))


def frontier(pairs: DataFrame, theta: DataFrame, done: DataFrame | None) -> DataFrame:
    """The pairs whose growth can matter at the thresholds and that aren't expanded yet: their own
    growth may reach it, or cover half of a pair that does and begins with their last word."""
    p = pairs.join(theta, "lang")
    need = p.where(F.col("score") >= F.col("theta")).groupBy("lang", F.col("a").alias("b")).agg(F.min("n").alias("_need"))
    out = p.join(need, ["lang", "b"], "left").where((F.col("bound") >= F.col("theta")) | (2 * F.col("n") >= F.col("_need"))).select(*pairs.columns)
    return out if done is None else out.join(done.select("lang", "a", "b"), ["lang", "a", "b"], "left_anti")


def survivors(pairs: DataFrame, grown: DataFrame, theta: DataFrame) -> DataFrame:
    """(lang, a, b, c, n, l, r, score): phrases that reach the threshold, without pairs of which a longer
    phrase covers half the occurrences."""
    ends = grown.select("lang", "a", "b", "n").unionByName(grown.select("lang", F.col("b").alias("a"), F.col("c").alias("b"), "n"))
    covered = ends.groupBy("lang", "a", "b").agg(F.max("n").alias("_n"))
    high = pairs.join(theta, "lang").where(F.col("score") >= F.col("theta")).join(covered, ["lang", "a", "b"], "left")
    two = high.where(F.col("_n").isNull() | (2 * F.col("_n") < F.col("n"))).select("lang", "a", "b", F.lit(None).cast("long").alias("c"), "n", "l", "r", "score")
    return two.unionByName(grown.join(theta, "lang").where(F.col("score") >= F.col("theta")).select(*two.columns))


def leading(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language by score and count, and all that equal the last of them in both."""
    counts = phrases.groupBy("lang", "score", "n").agg(F.count("*").alias("k"))
    before = F.sum("k").over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("n")).rowsBetween(W.unboundedPreceding, -1))
    within = counts.withColumn("_k", F.coalesce(before, F.lit(0))).where(F.col("_k") < top).select("lang", "score", "n")
    return phrases.join(within, ["lang", "score", "n"], "left_semi")


def spelled(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases with their words, lowered and joined by blanks (``phrase``)."""
    tables = {k: bit_table(phrases.where(F.col("c").isNull() if k == 2 else F.col("c").isNotNull()), k) for k in (2, 3)}

    def run(batches):
        import pyarrow as pa

        langs, seen = _Langs(), set()
        for lang, h, joined, raw, starts, ends in _texts(batches, langs):
            rows = []
            for k, bits in tables.items():
                at = _starts(joined, k)
                key = _key(langs.hashes[lang[at]], [h[at + j] for j in range(k)])
                hit = _has(bits.value, key)
                key, first = np.unique(key[hit], return_index=True)
                for x, i in zip(key.tolist(), at[hit][first].tolist(), strict=True):
                    if (k, x) not in seen:
                        seen.add((k, x))
                        text = b" ".join(raw[starts[j] : ends[j]].tobytes().lower() for j in range(i, i + k)).decode()
                        rows.append((int(lang[i]), *h[i : i + k].view(np.int64).tolist(), *[None] * (3 - k), text))
            if len(seen) > HELD:
                seen.clear()
            if rows:
                number, *cols, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([langs.strings(np.array(number)), *[pa.array(c, pa.int64()) for c in cols], pa.array(text, pa.string())], [*_columns(3), "phrase"])

    found = docs.mapInArrow(run, "lang string, a long, b long, c long, phrase string").groupBy("lang", "a", "b", "c").agg(F.min("phrase").alias("phrase"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) if c == "c" else F.col(f"x.{c}") == F.col(f"y.{c}") for c in _columns(3)]
    x, y = phrases.alias("x"), found.alias("y")
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return x.join(y, cond).select("x.*", "y.phrase")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, growth: int = GROWTH) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score (longs): each language's first ``top`` phrases of two or
    three words by score, count and spelling, among those that occur ``least`` times or more.

    docs: text and lang. A-Z are lowered; words are cut at blanks and tabs, phrases don't go beyond
    ``.,;:!?`` and line ends. A null text is empty, a null lang is und; repeated rows count each by
    itself; texts are read whole, whatever their length; other columns are not read. Ties end by
    spelling, so no two phrases share a rank. Languages without a frequent pair have no rows.
    """
    if least < 1 or top < 1 or growth < 2:
        raise ValueError("least and top are 1 or more, growth is 2 or more")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("_lang"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    with scratch():
        counted = written(count_words(docs, least), "words")
        pairs = written(count_pairs(docs, counted.where(F.col("a").isNotNull()), least), "pairs")
        frequent = bit_table(pairs, 2)
        place, theta, done, grown = growth * top, written(thresholds(pairs, growth * top), "theta"), None, None
        while True:
            expand = written(frontier(pairs, theta, done), "frontier")
            more = written(grow(docs, pairs, expand, frequent, least), "grown")
            done = expand if done is None else done.unionByName(expand)
            grown = more if grown is None else grown.unionByName(more)
            alive = written(survivors(pairs, grown, theta), "alive")
            settled = theta.join(alive.groupBy("lang").agg(F.count("*").alias("_k")), "lang", "left").select("lang", "theta", ((F.coalesce("_k", F.lit(0)) >= top) | (F.col("theta") == 0)).alias("settled"))
            if settled.where(~F.col("settled")).isEmpty():
                break
            place *= growth
            lower = thresholds(pairs, place).withColumnRenamed("theta", "_lower")
            theta = written(settled.join(lower, "lang").select("lang", F.when(F.col("settled"), F.col("theta")).otherwise(F.col("_lower")).alias("theta")), "theta")
        named = spelled(docs, written(leading(alive, top), "leading"))
        order = [F.desc("score"), F.desc("n"), "phrase"]
        some = named.withColumn("_i", F.row_number().over(W.partitionBy("lang", F.pmod("a", F.lit(SALTS))).orderBy(*order))).where(F.col("_i") <= top)
        ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        totals = counted.groupBy("lang").agg(F.sum("n").alias("_n"))
        return kept(ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("n").alias("a"), "l", "r", F.col("_n").alias("n"), "score"), "collocations")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, p FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
    FROM documents)
), listed AS (
  SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, CAST(len(w) - k + 2 AS BIGINT)), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
  FROM listed, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), cuts AS (
  SELECT f.lang, f.k, f.phrase, f.a, c.i, array_to_string(string_split(phrase, ' ')[1 : c.i], ' ') AS head, array_to_string(string_split(phrase, ' ')[c.i + 1 : ], ' ') AS tail
  FROM f, (SELECT unnest([1, 2]) AS i) c WHERE f.k > c.i AND f.a >= 10
), scored AS (
  SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, x.a AS l, y.a AS r,
         CAST(CAST(1000000 AS HUGEINT) * cuts.a * cuts.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score, cuts.i
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head AND x.k = cuts.i JOIN f y ON y.lang = cuts.lang AND y.phrase = tail AND y.k = cuts.k - cuts.i
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), longer AS (
  SELECT lang, part, max(a) AS a FROM (
    SELECT lang, a, array_to_string(string_split(phrase, ' ')[1 : 2], ' ') AS part FROM lowest WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(string_split(phrase, ' ')[2 : 3], ' ') FROM lowest WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT p.* FROM lowest p LEFT JOIN longer q ON p.lang = q.lang AND p.phrase = q.part
  WHERE q.a IS NULL OR 100 * q.a < 50 * p.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
