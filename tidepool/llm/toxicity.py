"""Toxicity of text that hides its words: a noisy channel, decoded by Viterbi.

The channel writes a letter as a look-alike sign (``1`` for i or l, ``@`` for a), repeats it, and
puts blanks or other signs between letters. A span of text that looks like its output becomes a
lattice: a sign is one of its letters or an edge between words, a letter or sign like the one
before may be nothing (a repetition), and what stands between letters is an edge or nothing.
A trigram character model with word edges, counted over all documents, picks the likeliest path;
the letters on it replace the span.

Which spans are decoded, numpy finds out for whole batches: tokens with signs among letters, letters
three times in a row or mostly doubled, rows of single letters, and neighbours that the character
model would rather see as one word. Other text can't change and isn't touched.

All words of the restored text are scored. Features are the words and their first 3 to 8 letters;
those that labelled toxic texts hold more often (a likelihood ratio) get weights from a logistic
regression on their counts, and a text's score is the logistic of its weighted sum.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import code_points, letter_classes, part_hashes, prefix_sums, runs, text_chunks
from .common import held_out, mix, randoms, scratch, sealed, table, written
from .quality_classifier import labelled

#: What a sign may stand for, besides itself (fixed values).
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
#: Signs that are punctuation unless a letter follows.
PUNCTUATION = "!|+$"
#: Log-probabilities of the channel: a letter as itself, as a sign, once more; a sign that means nothing.
SAME, CHANGED, AGAIN, NOISE = math.log(0.95), math.log(0.05), math.log(0.03), math.log(1e-4)
#: A letter torn from the one before by blanks, or by other signs alone, and once more after such a letter.
WIDE, TIGHT, ON = math.log(1e-3), math.log(3e-2), math.log(0.5)
#: Characters between two letters of a word, at most.
GAP = 3
#: Labelled rows to learn from, at most.
TRAIN_ROWS = 20_000
#: Size of the model: features at most, their least likelihood ratio (G), letters of a beginning.
FEATURES, LEAST_G, STARTS = 4096, 8.0, range(3, 9)
#: Features that are compared for those, at most: the ones that most toxic rows have.
CANDIDATES = 1 << 17
#: Of the regression: weight of the squares, and steps.
RIDGE, STEPS = 1e-4, 400
#: Spans that a task remembers.
REMEMBERED = 200_000

LONG_RUN = re.compile(r"(.)\1{2,}", re.S)
GAPS = re.compile("[^\\w" + re.escape("".join(LOOKALIKES)) + "]+|_+")
BLANK = re.compile(r"\s")

# -- the character model ------------------------------------------------------------------------

#: Symbols of the model: 0 is an edge between words, 1 to 27 are the classes of letters.
N = 28
LOOK = np.zeros(0x110000, np.uint8)
for _sign, _letters in LOOKALIKES.items():
    LOOK[ord(_sign)] = ord(_letters[0]) - 96


def trigrams(s: np.ndarray) -> np.ndarray:
    """Codes of the trigrams of all words of the symbols s, with two edges before and one after each."""
    before, two = np.roll(s, 1), np.roll(s, 2)
    before[:1], two[:2] = 0, 0
    two = np.where(before == 0, 0, two)
    some = (s > 0) | (before > 0)
    return ((two.astype(np.int32) * N + before) * N + s)[some]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(code, n) of the character trigrams of all texts; N^3 codes at most."""

    def run(batches):
        import pyarrow as pa

        total, classes = np.zeros(N**3, np.int64), letter_classes()
        for batch in batches:
            texts = [t.lower() if t else "" for t in batch.column("text").to_pylist()]
            for i, j in text_chunks(texts):
                total += np.bincount(trigrams(classes[code_points(texts[i:j])[0]]), minlength=N**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b), smoothed by p(c | b)."""
    x = counts.reshape(N, N, N).astype(float)
    two = x.sum(0) + 0.1
    two /= two.sum(1, keepdims=True)
    return np.log((x + 5 * two[None]) / (x.sum(2, keepdims=True) + 5))


def decode(span: str, lm: list, classes: np.ndarray) -> str:
    """The likeliest letters behind a span (lower case), words with a blank between.

    States are the last two symbols of the word, and how it got there: 2 right after a gap that was
    closed, 1 with one letter since, 0 otherwise.
    """
    beam: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
    last = ""
    for sign in LONG_RUN.sub(r"\1\1", span):
        letter = int(classes[ord(sign)])
        means = LOOKALIKES.get(sign, "")
        gap = not letter and not means
        if gap and last == " ":
            continue
        nxt: dict[tuple[int, int, int], tuple[float, str]] = {}

        def reach(state: tuple[int, int, int], p: float, out: str, nxt=nxt) -> None:
            if state not in nxt or nxt[state][0] < p:
                nxt[state] = (p, out)

        for (a, b, m), (p, out) in beam.items():
            here = lm[a][b]
            if letter:
                reach((b, letter, max(m - 1, 0)), p + SAME + here[letter], out + sign)
            for x in means:
                reach((b, ord(x) - 96, max(m - 1, 0)), p + CHANGED - math.log(len(means)) + here[ord(x) - 96], out + x)
            if not letter:  # an edge, if a word is under way
                q = p + (NOISE if means else 0.0)
                reach((0, 0, 0), q + here[0] if b else q, f"{out} " if b else out)
            if gap and b:
                reach((a, b, 2), p + (ON if m == 1 else TIGHT if sign == "." else WIDE), out)
            if sign == last and b:
                reach((a, b, m), p + AGAIN, out)
        beam, last = nxt, " " if gap else sign
    return max(((p + (lm[a][b][0] if b else 0.0), out) for (a, b, _), (p, out) in beam.items()), default=(0.0, ""))[1].strip()


def suspicious_spans(c: np.ndarray, lm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of the code points c (lower case) that are to be decoded."""
    classes = letter_classes()
    letter, look = classes[c], LOOK[c]
    symbol = np.where(letter > 0, letter, look)
    inside = symbol > 0
    starts, ends = runs(inside)
    n = len(starts)
    if not n:
        return starts, ends
    token = np.cumsum(np.diff(inside.astype(np.int8), prepend=0) == 1) - 1
    of = token[inside]
    has = lambda flag: np.bincount(of, weights=flag[inside], minlength=n)
    size, letters = ends - starts, has(letter > 0)
    # signs among letters; a punctuation sign counts if a letter follows
    signs = look > 0
    follow = np.zeros(len(c), bool)
    follow[:-1] = letter[1:] > 0
    for sign in PUNCTUATION:
        signs &= (c != ord(sign)) | follow
    # repeated letters
    same = np.zeros(len(c), bool)
    same[1:] = (c[1:] == c[:-1]) & (letter[1:] > 0)
    thrice = same.copy()
    thrice[1:] &= same[:-1]
    twice = has(same)
    odd = (letters > 0) & ((has(signs & inside) > 0) | (has(thrice) > 0) | ((twice > 1) & (2 * twice >= size - 1)))
    if n == 1:
        return starts[odd], ends[odd]
    # neighbours that may be torn apart
    e, f = ends[:-1] - 1, starts[1:]
    newline = np.concatenate([[0], np.cumsum(c == 10)])
    near = (f - e <= GAP + 1) & (newline[f] == newline[e])
    plain = (letters > 0) | (size == 1)
    near &= plain[:-1] & plain[1:]
    single = ((twice == size - 1) | (size == 1)) & plain
    a = np.where(size[:-1] > 1, symbol[e - 1], 0)
    b, x = symbol[e], symbol[f]
    y = np.where(size[1:] > 1, symbol[np.minimum(f + 1, len(c) - 1)], 0)
    split = lm[a, b, 0] + lm[0, 0, x] + lm[0, x, y]
    blank = np.concatenate([[0], np.cumsum((c == 32) | (c == 9) | (c == 0xA0))])
    torn = np.where(blank[f] > blank[e], WIDE, TIGHT)
    join = near & (lm[a, b, x] + lm[b, x, y] + torn > split) & (letters[:-1] > 0) & (letters[1:] > 0)
    # three or more single letters (or one letter repeated) in a row
    pair = near & single[:-1] & single[1:]
    row = pair.copy()
    row[1:] &= pair[:-1]
    long = row.copy()
    long[:-1] |= row[1:]
    join |= long
    # spans: tokens joined to the next one, with single letters and odd tokens next to them
    group = np.concatenate([[0], np.cumsum(~join)])
    first = np.flatnonzero(np.concatenate([[True], ~join]))
    last = np.append(first[1:] - 1, n - 1)
    use = (first < last) & (np.add.reduceat(letters, first) > 1)
    use |= np.bincount(group, weights=odd, minlength=len(first)) > 0
    return starts[first[use]], ends[last[use]]


class Restorer:
    """Restores texts, and remembers the spans it has met."""

    def __init__(self, lm: np.ndarray):
        self.table, self.lists, self.known = lm, lm.tolist(), {}

    def span(self, s: str) -> str:
        if s not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            # gaps as one sign: a dot without a blank in it, a blank with one
            out = decode(GAPS.sub(lambda m: " " if BLANK.search(m[0]) else ".", s), self.lists, letter_classes())
            keep = "".join(ch if letter_classes()[ord(ch)] else " " for ch in s).split()
            self.known[s] = s if out.split() == keep else out  # words that stay keep what is between them
        return self.known[s]

    def restore(self, texts: list[str]) -> tuple[list[str], list[list[tuple[str, str]]]]:
        """Lower-case texts with their spans restored, and (span, restored) of those that changed."""
        c, at = code_points(texts)
        starts, ends = suspicious_spans(c, self.table)
        out, changed = list(texts), [[] for _ in texts]
        doc = np.searchsorted(at, starts, side="right") - 1
        edges = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            d = int(doc[i])
            text, parts, to = texts[d], [], 0
            for k in range(i, j):
                s, e = int(starts[k] - at[d]), int(ends[k] - at[d])
                was = text[s:e]
                now = self.span(was)
                if now != was:
                    parts += [text[to:s], now]
                    changed[d].append((was, now))
                    to = e
            out[d] = "".join(parts) + text[to:] if parts else text
        return out, changed


# -- what is toxic ------------------------------------------------------------------------------


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every word and every word's beginnings in lower-case texts."""
    c, at = code_points(texts)
    starts, ends = runs(letter_classes()[c] > 0)
    sums, sizes = prefix_sums(c, starts, ends), ends - starts
    doc = np.searchsorted(at, starts, side="right") - 1
    out, owner = [part_hashes(sums, starts, sizes, 1)], [doc]
    for k in STARTS:
        long = sizes >= k
        out.append(part_hashes(sums, starts[long], k, 2))
        owner.append(doc[long])
    return np.concatenate(out), np.concatenate(owner)


def counted(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, hash) in order, and how often each occurs."""
    by = np.lexsort((h, owner))
    h, owner = h[by], owner[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    return owner[begin], h[begin], np.diff(np.append(begin, len(h)))


@dataclass
class Model:
    """lm: log p(c | a, b); hashes (sorted) and weights of the features; bias: log-odds of a text without any."""

    lm: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray
    bias: float
    maybe: np.ndarray = field(init=False)

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> np.uint64(48)).astype(np.int64)] = True

    def known(self, h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature number, text) of those that the model has."""
        some = self.maybe[(h >> np.uint64(48)).astype(np.int64)]
        h, owner = h[some], owner[some]
        if not len(self.hashes):
            return np.zeros(0, np.int64), owner[:0]
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = self.hashes[at] == h
        return at[same], owner[same]

    def log_odds(self, texts: list[str]) -> np.ndarray:
        """Of lower-case restored texts."""
        owner, f, n = counted(*self.known(*features(texts)))
        return self.bias + np.bincount(owner, weights=self.weights[f] * np.log1p(n), minlength=len(texts))


def _lowered(batch) -> list[str]:
    return [t.lower() if t else "" for t in batch.column("text").to_pylist()]


def restored_sample(rows: DataFrame, lm: np.ndarray) -> DataFrame:
    """(label, kin, text) of each row (text, label), restored. ``kin`` is equal for near copies: a hash of
    the smallest feature hashes in two orders."""
    value = rows.sparkSession.sparkContext.broadcast(lm)

    def run(batches):
        import pyarrow as pa

        restorer = Restorer(value.value)
        a, b = randoms(2, 40)
        for batch in batches:
            low = _lowered(batch)
            for i, j in text_chunks(low):
                texts = restorer.restore(low[i:j])[0]
                h, owner = features(texts)
                least = np.full((2, j - i), ~np.uint64(0))
                for k, seed in enumerate((a, b)):
                    np.minimum.at(least[k], owner, mix(h ^ seed))
                with np.errstate(over="ignore"):
                    kin = mix(least[0] + least[1] * b).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), pa.array(kin), pa.array(texts, pa.string())], ["label", "kin", "text"])

    return rows.select("text", "label").mapInArrow(run, "label int, kin long, text string")


def weighted_counts(rows: DataFrame, among: np.ndarray | None = None) -> DataFrame:
    """(hash, n): the weights of the rows (text, weight) that have each feature, or each ``among`` these
    (sorted). A task adds up its own rows first."""
    value = rows.sparkSession.sparkContext.broadcast(among)

    def run(batches):
        import pyarrow as pa

        known = None if value.value is None else Model(np.zeros(0), value.value, np.zeros(0), 0.0)
        hashes, weights, held = [], [], 0

        def added() -> None:
            u, at = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(weights))
            hashes[:], weights[:] = [u], [n]

        for batch in batches:
            texts, weight = batch.column("text").to_pylist(), batch.column("weight").to_numpy()
            for i, j in text_chunks(texts):
                h, owner = features(texts[i:j])
                if known is not None:
                    f, owner = known.known(h, owner)
                    h = known.hashes[f]
                owner, h, _ = counted(h, owner)
                hashes.append(h)
                weights.append(weight[i:j][owner])
                held += len(h)
                if held > 1_000_000:
                    added()
                    held = 0
        if hashes:
            added()
            yield pa.RecordBatch.from_arrays([pa.array(hashes[0].view(np.int64)), pa.array(weights[0])], ["hash", "n"])

    return rows.select("text", "weight").mapInArrow(run, "hash long, n double").groupBy("hash").agg(F.round(F.sum("n"), 6).alias("n"))


def regression(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, labels: np.ndarray, weights: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, by accelerated gradient steps; the given
    (row, column, value) are the matrix."""
    n, share = len(labels), weights / weights.sum()
    times = lambda z: np.bincount(rows, weights=values * z[cols], minlength=n)
    back = lambda r: np.bincount(cols, weights=values * r[rows], minlength=size)
    z = np.ones(size)
    for _ in range(20):  # the largest eigenvalue bounds the step
        z = back(share * times(z))
        top = np.linalg.norm(z)
        z = z / max(top, 1e-12)
    pace = 0.25 * (top + 1) * 1.05 + RIDGE
    p = (share @ labels * n + 1) / (n + 2)
    w, b, t = np.zeros(size), math.log(p / (1 - p)), 1.0
    z, zb = w, b
    for _ in range(STEPS):
        slack = share * (1 / (1 + np.exp(-np.clip(times(z) + zb, -50, 50))) - labels)
        w2, b2 = z - (back(slack) + RIDGE * z) / pace, zb - slack.sum() / pace
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, zb = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def hashes_of(rows: DataFrame) -> np.ndarray:
    """The hashes of a bounded table, sorted."""
    return np.sort(np.array([r["hash"] for r in rows.select("hash").collect()], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """Characters are counted in all documents; features and weights are learned from labelled rows,
    TRAIN_ROWS of them at most. Near copies among those share the weight of one row, so that a text that
    is copied a thousand times doesn't make its words toxic. Without labelled rows of both kinds
    every text gets the labels' shares."""
    counts = np.zeros(N**3, np.int64)
    for r in count_trigrams(docs).collect():  # N^3 at most
        counts[r["code"]] = r["n"]
    lm = language_model(counts)
    none = Model(lm, np.zeros(0, np.uint64), np.zeros(0), 0.0)
    with scratch():
        found = written(restored_sample(labelled(docs, labels, "toxic", most), lm), "sample")
        kin = found.groupBy(F.col("kin").alias("k")).agg((1 / F.count("*")).alias("weight"))
        rows = found.join(F.broadcast(kin), F.col("kin") == F.col("k")).select("label", "weight", "text")  # most rows
        total = rows.agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("label")).alias("a")).first()
        if not total["n"]:
            return none
        bad, all_ = total["a"], total["n"]
        none.bias = math.log((bad + 0.5) / (all_ - bad + 0.5))
        if not 0 < bad < all_ - 1e-9:
            return none
        # a feature of toxic rows alone has G = 2 a log(1 / rate); with less than this it can't reach LEAST_G
        least = LEAST_G / (2 * math.log(all_ / bad))
        toxic = weighted_counts(rows.where("label = 1")).where(F.col("n") >= least).orderBy(F.desc("n"), "hash").limit(CANDIDATES).withColumnRenamed("n", "a")
        toxic = written(toxic, "candidates")
        each = toxic.join(weighted_counts(rows, hashes_of(toxic)).withColumnRenamed("hash", "h"), F.col("hash") == F.col("h"))
        a, n, rate = F.col("a"), F.col("n"), F.lit(bad / all_)
        part = lambda x, e: F.when(x > 1e-5, x * F.log(x / e)).otherwise(0.0)
        g = F.round(2 * (part(a, n * rate) + part(n - a, n * (1 - rate))), 4)
        chosen = hashes_of(each.where(a > n * rate).select("hash", g.alias("g")).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "hash").limit(FEATURES))
        if not len(chosen):
            return none
        got = chosen_features(rows, chosen).toPandas()  # most rows, of the chosen features only
    # tasks end in any order; the regression's sums shouldn't depend on it
    order = sorted(range(len(got)), key=lambda i: (got["label"][i], got["weight"][i], tuple(got["columns"][i]), tuple(got["counts"][i])))
    got = got.iloc[order]
    size = got["columns"].map(len).to_numpy()
    matrix = np.repeat(np.arange(len(got)), size), np.concatenate(got["columns"].to_list()).astype(np.int64), np.log1p(np.concatenate(got["counts"].to_list()))
    weights, bias = regression(*matrix, got["label"].to_numpy(float), got["weight"].to_numpy(), len(chosen))
    return Model(lm, chosen, weights, bias)


def chosen_features(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(label, weight, columns, counts): the features of each row that are chosen, as numbers."""
    value = rows.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        import pyarrow as pa

        model = Model(np.zeros(0), value.value, np.zeros(0), 0.0)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in text_chunks(texts):
                owner, f, n = counted(*model.known(*features(texts[i:j])))
                cut = pa.array(np.searchsorted(owner, np.arange(j - i + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in (f, n)]
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), batch.column("weight").slice(i, j - i), *lists], ["label", "weight", "columns", "counts"])

    return rows.select("label", "weight", "text").mapInArrow(run, "label int, weight double, columns array<int>, counts array<int>")


CHANGES = "array<struct<was:string,now:string>>"


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """All columns of docs with score (0 to 1), restored (each span that the channel was undone in, as it
    was in lower case and as it is now) and predicted (1 from ``threshold`` on).

    Null and empty texts hold no word and get the prior; texts of any length are taken whole;
    repeated rows score alike. Columns of docs named like those three are replaced, others stay
    whatever they are called.
    """
    value = docs.sparkSession.sparkContext.broadcast(model)
    docs, back = sealed(docs, "doc_id", "text")

    def run(batches):
        import pyarrow as pa

        m = value.value
        restorer = Restorer(m.lm)
        for batch in batches:
            low, z, spans = _lowered(batch), [], []
            for i, j in text_chunks(low):
                texts, changed = restorer.restore(low[i:j])
                z.append(m.log_odds(texts))
                spans += [[{"was": a, "now": b} for a, b in x] for x in changed]
            p = np.round(1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *z]), -50, 50))), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(spans, pa.list_(pa.struct([("was", pa.string()), ("now", pa.string())])))], [*batch.schema.names, "score", "restored"])

    more = [T.StructField("score", T.DoubleType()), *T._parse_datatype_string(f"restored {CHANGES}").fields]
    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))
    return back(out.withColumn("predicted", (F.col("score") >= threshold).cast("int")), "score", "restored", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
