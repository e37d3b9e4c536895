"""Sequence features as columns, long tables and MLlib vectors."""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import product

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, CountVectorizerModel, MinMaxScaler, Normalizer, StandardScaler, UnivariateFeatureSelector, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import batches as B
from ..functions import sequence as S


#: Different (group, word) that a task holds before it passes their counts on; numbers in a dense table of shares.
HELD, DENSE = 1_000_000, 4_000_000
#: Words before and behind a word that are its neighbours; steps and first rate of the fit of word vectors.
WINDOW, STEPS, RATE = 5, 500, 0.02


def kmer_counts(df: DataFrame, ks: tuple[int, ...] = (3, 4, 5, 6), group: tuple[str, ...] = (), seq: str = "seq") -> DataFrame:
    """(group, k, kmer, n). Tasks count base-4 numbers in Arrow batches, only those that occur, and pass on each (group, k,
    word) once for HELD others at most."""
    fields = [df.schema[g] for g in group]
    schema = T.StructType([*fields, T.StructField("k", T.IntegerType()), T.StructField("code", T.IntegerType()), T.StructField("n", T.LongType())])
    first = np.cumsum([0, *[4**k for k in ks]])  # the words of all lengths in a row

    def run(batches):
        import pyarrow as pa

        kinds = to_arrow_schema(schema)
        names: dict[tuple, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            word, at = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return word, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)

        def passed_on(word, n):
            of, word = np.divmod(word, first[-1])
            at = np.searchsorted(first, word, side="right") - 1
            groups = list(names)
            cols = [pa.array([g[i] for g in groups], kinds.field(i).type).take(pa.array(of)) for i in range(len(group))]
            return pa.RecordBatch.from_arrays([*cols, pa.array(np.array(ks, np.int32)[at]), pa.array((word - first[at]).astype(np.int32)), pa.array(n)], kinds.names)

        for batch in batches:
            own = list(zip(*[batch.column(g).to_pylist() for g in group], strict=True)) if group else [()] * batch.num_rows
            number = np.array([names.setdefault(g, len(names)) for g in own], np.int64)
            raw, at = B.string_bytes(batch.column("_s"))
            for row, end, part, off in B.chunks(raw, at):
                for k, start in zip(ks, first, strict=False):
                    code, of = B.kmer_codes(part, off, k)
                    held.append(np.unique(number[row:end][of] * first[-1] + start + code, return_counts=True))
                if sum(len(w) for w, _ in held) > HELD:
                    held = [added()]
                    if len(held[0][0]) > HELD // 2:
                        yield passed_on(*held[0])
                        held, names = [], {}
                        number = np.array([names.setdefault(g, len(names)) for g in own], np.int64)
        if held:
            yield passed_on(*added())

    rows = df.select(*group, F.coalesce(F.col(seq), F.lit("")).alias("_s"))
    total = rows.mapInArrow(run, schema).groupBy(*group, "k", "code").agg(F.sum("n").alias("n"))
    longest = max(ks)
    letters = [F.when(F.col("k") > i, F.substring(F.lit("ACGT"), F.shiftright("code", 2 * i).bitwiseAND(F.lit(3)) + 1, F.lit(1))).otherwise("") for i in range(longest - 1, -1, -1)]
    return total.select(*group, "k", F.concat(*letters).alias("kmer"), "n")


def vocabulary(k: int) -> list[str]:
    return ["".join(p) for p in product("ACGT", repeat=k)]


def _shares(k: int, vectors: np.ndarray | None = None):
    """The relative frequencies of all words, or the mean of the words' vectors."""

    def shares(seq):
        raw, at = B.string_bytes(seq)
        out = np.zeros((len(at) - 1, 4**k if vectors is None else vectors.shape[1]))
        step = max(1, DENSE // 4**k)
        for row, end, part, off in B.chunks(raw, at, B.FEW_BYTES):
            for a in range(0, end - row, step):
                own = off[a : min(a + step, end - row) + 1]
                code, of = B.kmer_codes(part[own[0] : own[-1]], own - own[0], k)
                n = np.bincount(of * 4**k + code, minlength=(len(own) - 1) * 4**k).reshape(len(own) - 1, -1)
                share = n / np.maximum(n.sum(1, keepdims=True), 1)
                out[row + a : row + a + len(n)] = share if vectors is None else share @ vectors
        return B.lists(out)

    return F.arrow_udf(shares, "array<double>")


def kmer_vector(df: DataFrame, k: int = 4, seq: str = "seq", out: str = "features") -> DataFrame:
    """A vector of the relative frequencies of all 4^k words, in lexicographic order, zeros for a sequence without a
    clean word (or null). Up to k = 5 words are counted as numbers in Arrow batches, longer ones as strings, as most of their
    vector is zero."""
    if k <= 5:
        return df.withColumn(out, array_to_vector(_shares(k)(F.coalesce(F.col(seq), F.lit("")))))
    model = CountVectorizerModel.from_vocabulary(vocabulary(k), inputCol="_w", outputCol="_n", minTF=1.0)
    counted = model.transform(df.withColumn("_w", S.kmers(F.coalesce(F.col(seq), F.lit("")), k)))
    return Normalizer(p=1.0, inputCol="_n", outputCol=out).transform(counted).drop("_w", "_n")


def _composition():
    def parts(seq):
        import pyarrow as pa
        import pyarrow.compute as pc

        raw, at = B.string_bytes(seq)
        n = len(at) - 1
        pairs, gc = np.zeros((n, 16)), np.zeros(n)
        for row, end, part, off in B.chunks(raw, at, B.FEW_BYTES):
            code, of = B.kmer_codes(part, off, 2)
            c = np.bincount(of * 16 + code, minlength=(end - row) * 16).reshape(-1, 16)
            pairs[row:end] = c / np.maximum(c.sum(1, keepdims=True), 1)
            one, of = B.kmer_codes(part, off, 1)
            all_ = np.bincount(of, minlength=end - row)
            gc[row:end] = np.bincount(of, weights=(one == 1) | (one == 2), minlength=end - row) / np.maximum(all_, 1)
        # lengths are in characters; other signs than bases may have several bytes
        length = pc.fill_null(pc.utf8_length(seq), 0).cast(pa.int32())
        return pa.StructArray.from_arrays([length, pa.array(gc), B.lists(pairs)], ["length", "gc", "pairs"])

    return F.arrow_udf(parts, "struct<length:int,gc:double,pairs:array<double>>")


def composition(df: DataFrame, seq: str = "seq") -> DataFrame:
    """length, gc and the frequency of each of the 16 pairs of bases among the clean pairs, in one pass
    over Arrow batches. A null sequence counts as empty."""
    c = df.withColumn("_c", _composition()(F.col(seq)))
    return c.withColumns({"length": F.col("_c.length"), "gc": F.col("_c.gc")} | {f"f_{w.lower()}": F.round(F.get("_c.pairs", F.lit(i)), 6) for i, w in enumerate(vocabulary(2))}).drop("_c")


def word_pairs(df: DataFrame, k: int, seq: str = "seq") -> DataFrame:
    """(pair, n): the words a and b behind it, as a * 4^k + b, that are neighbours in a sequence's clean words. Those at distance
    d count WINDOW + 1 - d times, as that many of the WINDOW windows that Word2Vec draws from hold them. A task passes on
    each pair once."""

    def run(batches):
        import pyarrow as pa

        n = np.zeros(16**k, np.int64)
        for batch in batches:
            for _, _, part, off in B.chunks(*B.string_bytes(batch.column(0))):
                code, of = B.kmer_codes(part, off, k)
                for d in range(1, WINDOW + 1):
                    n += (WINDOW + 1 - d) * np.bincount((code[:-d] * 4**k + code[d:])[of[:-d] == of[d:]], minlength=16**k)
        pair = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n[pair])], ["pair", "n"])

    return df.select(F.coalesce(F.col(seq), F.lit("")).alias("_s")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def skip_gram(n: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Vectors of words that are neighbours n[a, b] times: Word2Vec's model (skip-grams, a Huffman tree of binary choices), whose
    likelihood depends on these counts only. It takes STEPS steps on all pairs at once (Adam, the rate falls to 0) from small
    random vectors; a word without neighbours keeps its own."""
    total = n.sum(0)
    heap = [(int(total[w]), int(w), [int(w)]) for w in np.flatnonzero(total)]
    heapify(heap)
    turn = np.zeros((max(len(heap) - 1, 0), len(n)))
    for node in range(len(turn)):
        (a, _, left), (b, _, right) = heappop(heap), heappop(heap)
        turn[node, left], turn[node, right] = 1, -1
        heappush(heap, (a + b, len(n) + node, left + right))
    share = n / max(int(total.sum()), 1)
    yes, no = share @ (turn.T > 0), share @ (turn.T < 0)
    own = [(np.random.default_rng(seed).random((len(n), dim)) - 0.5) / dim, np.zeros((len(turn), dim))]
    mean, square = [np.zeros_like(x) for x in own], [np.zeros_like(x) for x in own]
    for t in range(STEPS):
        up = yes - (yes + no) / (1 + np.exp(-(own[0] @ own[1].T)))
        for x, g, m, s in zip(own, (up @ own[1], up.T @ own[0]), mean, square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            x += RATE * (1 - t / STEPS) * m / (1 - 0.9 ** (t + 1)) / (np.sqrt(s / (1 - 0.999 ** (t + 1))) + 1e-15)
    return own[0]


def kmer_word2vec(df: DataFrame, k: int = 4, dim: int = 128, seq: str = "seq", seed: int = 42, partitions: int | None = None) -> DataFrame:
    """Mean of the learned vectors of a sequence's words; zeros for a sequence without a clean word (or null).

    Up to k = 5 all neighbours of all words are counted in one pass and the vectors are fitted to the counts, so the fit takes
    the same time for any number of sequences. Longer words have too many pairs for that; MLlib's Word2Vec walks over them in
    ``partitions`` tasks, as many as the session shuffles to if not given."""
    if k <= 5:
        n = np.zeros(16**k, np.int64)
        counted = word_pairs(df, k, seq).toArrow()
        n[counted["pair"].to_numpy()] = counted["n"].to_numpy()
        n = n.reshape(4**k, 4**k)
        return df.withColumn("features", array_to_vector(_shares(k, skip_gram(n + n.T, dim, seed))(F.coalesce(F.col(seq), F.lit("")))))
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = df.withColumn("_w", S.kmers(F.coalesce(F.col(seq), F.lit("")), k))
    model = Word2Vec(vectorSize=dim, minCount=1, seed=seed, numPartitions=partitions, maxIter=1, inputCol="_w", outputCol="features").fit(words)
    return model.transform(words).drop("_w")


def as_vector(df: DataFrame, column: str = "embedding", out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(column).cast("array<double>")))


def scale_features(df: DataFrame, method: str = "standard", column: str = "features") -> DataFrame:
    kind = StandardScaler(withMean=True, inputCol=column, outputCol="scaled") if method == "standard" else MinMaxScaler(inputCol=column, outputCol="scaled")
    return kind.fit(df).transform(df)


def select_features(df: DataFrame, k: int = 1000, column: str = "features", label: str = "label") -> DataFrame:
    size = len(df.select(vector_to_array(column)).first()[0])
    chosen = UnivariateFeatureSelector(featuresCol=column, outputCol="selected", labelCol=label, selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(min(k, size))
    return chosen.fit(df).transform(df)


def reduce_dims(df: DataFrame, n: int = 50, column: str = "features") -> DataFrame:
    model = Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol=column, outputCol="_c"), PCA(k=n, inputCol="_c", outputCol="reduced")]).fit(df)
    return model.transform(df).drop("_c")


def mean_pool(tokens: DataFrame, key: str = "sequence_id", vector: str = "vector", mask: str | None = "mask") -> DataFrame:
    """One vector for each sequence, the mean of its token vectors; masked (padding) tokens don't count."""
    rows = tokens.where(F.col(mask)) if mask else tokens
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>")))).alias("embedding"))


def augment_revcomp(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Every row, and once more with the reverse complement."""
    return df.withColumn("reversed", F.lit(False)).unionByName(df.withColumns({seq: S.reverse_complement(F.col(seq)), "reversed": F.lit(True)}))
