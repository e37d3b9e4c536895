"""The ten operators against brute force, and on awkward tables."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import chat_format, decontaminate, jaccard_join, line_dedup, packing, quality_classifier, quality_rules, token_count, toxicity, url_filter
from tidepool.llm.components import components
from tidepool.llm.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
#: Held-out accuracy needs more labelled rows than the smallest tables have.
MORE = "/root/testdata/sf0.01"
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Columns that operators use or give themselves.
CLASHES = ["score", "predicted", "restored", "n_words", "matches", "n_hit", "items", "contaminated", "n_lines", "n_removed", "_k", "_d", "_j", "_l", "_w", "_t", "cut", "node", "label", "key", "h", "k", "piece", "length", "_s", "weight", "own_1__"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DIR}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ids that repeat, clashing columns."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    t = [(1, None), (2, ""), (3, " \n\t\n "), (4, long), (5, long), (6, "x" * 300_000), (7, "same text of a few words"), (7, "same text of a few words"), (7, "another one"), (None, "same text of a few words"), (None, None), (8, "a\nb\nc\nd"), (9, "q\na\nb\nc"), (10, "é ñ 日本 <|endoftext|> \u2028 \\b<")]
    return spark.createDataFrame([(i, x, None, None, None, *CLASHES) for i, x in t], SCHEMA)


def collected(df, *key):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR), duck.sql(ORACLE[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(repr(tuple(r)) for r in got.select(*cols).collect()) == sorted(repr(r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_token_counts_are_the_librarys(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    for df in (docs, odd):
        got = collected(token_count.count_tokens(df, TOKENIZER))
        rows = [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
        n = [len(e.ids) for e in t.encode_batch([x for _, x in rows], add_special_tokens=False)]
        assert got == sorted(((i, len(x.encode()), k, k > 512) for (i, x), k in zip(rows, n, strict=True)), key=repr)


def test_random_pieces_merge_like_the_library():
    from tokenizers import Tokenizer

    t, count, r = Tokenizer.from_file(TOKENIZER), token_count.counter(TOKENIZER).count, random.Random(5)
    for _ in range(300):
        s = "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x250), r.randrange(0x3000), 0x1F600])) for _ in range(r.randrange(80)))
        assert count(s) == len(t.encode(s, add_special_tokens=False).ids), s


def crc5(i):
    return zlib.crc32(str(i).encode()) % 5


def area(score, label):
    """Share of pairs of a 1 and a 0 in which the 1 scores higher."""
    one, zero = [np.array([s for s, y in zip(score, label, strict=True) if y == k]) for k in (1, 0)]
    return ((one[:, None] > zero[None]) + 0.5 * (one[:, None] == zero[None])).mean()


def test_quality_classifier_on_held_out_rows(spark, docs, labels, odd):
    more, marks = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality_classifier.score(more, quality_classifier.fit(more, marks)).collect()}
    model = quality_classifier.fit(docs, labels)
    rows = [(r.doc_id, r.quality) for r in marks.collect() if crc5(r.doc_id) == 0]
    assert sum(got[i].predicted == q for i, q in rows) / len(rows) >= 0.9
    assert area([got[i].score for i, _ in rows], [q for _, q in rows]) >= 0.95
    out = quality_classifier.score(odd, model)
    assert out.columns == [c for c in odd.columns if c not in ("score", "predicted")] + ["score", "predicted"]
    rows = out.collect()
    assert len(rows) == odd.count() and all(r[c] == c for r in rows for c in CLASHES if c not in ("score", "predicted"))
    prior = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(prior) == 1 and len({r.score for r in rows if r.text == "same text of a few words"}) == 1
    assert quality_classifier.score(docs.limit(0), quality_classifier.fit(docs.limit(0), labels)).count() == 0


def test_quality_features_and_steps():
    """Features against a loop over characters, and training against plain arithmetic."""
    texts = ["", "a bb\tccc", "éé é", " x  yz\n", "日本語 日本語"]
    f, owner = quality_classifier.features(texts)
    for i, t in enumerate(texts):
        w = t.split()
        padded = f"\n{t}\n"
        grams = [padded[p : p + 3] for p in range(len(padded) - 2) if not padded[p + 1].isspace()]
        grams += [x[p : p + g] for x in w for g in (1, 2) for p in range(len(x) - g + 1)]
        assert (owner == i).sum() == len(w) + max(0, len(w) - 1) + len(grams)
    for one, other in (("zz zz", "qq qq"), ("ab cd", "ef gh")):  # nothing is the same for all words
        f, owner = quality_classifier.features([one, other])
        assert not set(f[owner == 0].tolist()) & set(f[owner == 1].tolist())
    words_and_pair = lambda t: set(quality_classifier.features([t])[0][:3].tolist())
    assert len(words_and_pair("ab cd") & words_and_pair("cd ab")) == 2  # a pair has an order
    rows = [(np.array([1, 5]), np.array([0.5, 0.5], np.float32)), (np.array([5, 9]), np.array([0.25, 0.75], np.float32)), (np.array([], int), np.array([], np.float32))]
    y = np.array([1, 0, 1])
    weight, prior = quality_classifier.train(rows, y, epochs=1)
    rng = np.random.default_rng(7)
    v = rng.uniform(-1 / quality_classifier.DIM, 1 / quality_classifier.DIM, (quality_classifier.BUCKETS, quality_classifier.DIM)).astype(np.float32)
    w, done = [[0.0] * quality_classifier.DIM for _ in range(2)], 0
    for i in rng.permutation(3):
        rate = quality_classifier.RATE * (1 - done / 3)
        done += 1
        u, c = rows[i]
        if not len(u):
            continue
        hidden = [sum(float(c[k]) * float(v[u[k]][d]) for k in range(len(u))) for d in range(quality_classifier.DIM)]
        z = [sum(a * b for a, b in zip(w[k], hidden, strict=True)) + (prior / 2 if k else -prior / 2) for k in range(2)]
        e = [np.exp(x - max(z)) for x in z]
        p = [x / sum(e) for x in e]
        p[y[i]] -= 1
        back = [sum(w[k][d] * p[k] for k in range(2)) for d in range(quality_classifier.DIM)]
        long = max(1.0, sum(x * x for x in back) ** 0.5 / quality_classifier.CLIP)
        back = [x / long for x in back]
        w = [[w[k][d] - rate * p[k] * hidden[d] for d in range(quality_classifier.DIM)] for k in range(2)]
        for k in range(len(u)):
            v[u[k]] -= np.array([rate * float(c[k]) * b for b in back], np.float32)
    assert np.allclose(weight[[1, 5, 9]], [sum(v[k][d] * (w[1][d] - w[0][d]) for d in range(quality_classifier.DIM)) for k in (1, 5, 9)], atol=1e-5)


def test_quality_rules_against_brute_force(spark, duck, docs, labels, odd, texts):
    xxhash = pytest.importorskip("xxhash")
    trusted = {r.doc_id for r in quality_rules.trusted_ids(labels).collect()}
    assert trusted == {i for i, q in duck.sql("SELECT doc_id, quality FROM labels").fetchall() if q == 1 and crc5(i)}

    def chain(parts):  # Spark's xxhash64: each value's hash seeds the next
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), seed=h)
        return (h - (1 << 64) if h >> 63 else h) % quality_rules.BUCKETS

    def grams(t):
        tok = re.findall(r"[^\W_]+|(?:[^\s\w]|_)+", t.lower())
        return [chain([a]) for a in tok] + [chain(p) for p in zip(tok, tok[1:], strict=False)]

    ascii_only = {i: t for i, t in texts.items()}
    g = {i: grams(t) for i, t in ascii_only.items()}
    raw, good = np.ones(quality_rules.BUCKETS), np.ones(quality_rules.BUCKETS)
    for i, x in g.items():
        np.add.at(raw, x, 1)
        if i in trusted:
            np.add.at(good, x, 1)
    w = np.log(good / good.sum()) - np.log(raw / raw.sum())
    for r in quality_rules.judge_quality(docs, quality_rules.trusted_ids(labels)).collect():
        t = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(zip(words, words[1:], words[2:], strict=False))
        hit = {p + j for p in range(len(words) - 2) if c[tuple(words[p : p + 3])] > 1 for j in range(3)}
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert abs(r.ratio - (w[g[r.doc_id]].mean() if g[r.doc_id] else 0)) < 2e-6
        assert r.kept == (not failed and r.ratio >= quality_rules.THRESHOLD)
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.kept) for r in quality_rules.judge_quality(odd, quality_rules.trusted_ids(labels)).collect()}
    assert {(1, 0, 0, False), (2, 0, 0, False), (3, 0, 0, False), (None, 0, 0, False), (4, 60_000, 60_000, False), (6, 1, 0, False), (8, 4, 0, False), (None, 6, 0, False)} <= got
    assert quality_rules.judge_quality(odd, quality_rules.trusted_ids(labels)).count() == odd.count()
    many = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    assert sorted(quality_rules.trusted_ids(many, 7).collect()) == sorted(quality_rules.trusted_ids(many.repartition(9), 7).collect())
    assert quality_rules.judge_quality(odd.limit(0), quality_rules.trusted_ids(labels.limit(0))).count() == 0


def test_line_dedup(spark, odd):
    a = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(odd).collect()}
    assert (8, "a\nb\nc\nd") in a and (9, "q") in a and (1, None) in a and (3, " \n\t\n ") in a
    rows = line_dedup.dedup_lines(odd)
    assert rows.columns == [c for c in odd.columns if c not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    assert rows.count() == odd.count() and all(r[c] == c for r in rows.collect() for c in CLASHES if c not in ("n_lines", "n_removed"))
    rows = [(1, "a\nb\nc\n\nd"), (2, "x\nb\n \nc\nd\ny"), (3, "a\na\na\na\na"), (None, "b\nc\nd")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("a\nb\nc\n\nd", 0), 2: ("x\ny", 4), 3: ("a", 4), None: ("", 3)}
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_chat_trees(spark):
    rows = [(1, 0, None, "user", "hi", 0.0), (1, 1, 0, "assistant", "</turn>\\", 0.5), (1, 2, 0, "assistant", "better", 0.9), (1, 3, 2, "user", None, None), (2, 5, 9, None, "orphan", 1.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (3, 4, 1, "user", "below", 0.0), (None, 1, None, "assistant", "no conversation", 0.0), (1, None, 0, "user", "x", 1.0), (1, 0, None, "user", "hi", 0.0)]
    df = spark.createDataFrame([(*r, "?") for r in rows], "conv_id long, node long, parent long, role string, text string, score double, formatted string")
    got = {(r.conv_id, r.leaf): r for r in chat_format.read_back(chat_format.format_trees(df)).collect()}
    # equal rows and rows without a node are leaves of their own
    assert set(got) == {(1, None), (1, 0), (1, 1), (1, 3), (2, 5), (None, 1)}
    assert [(t.role, t.text) for t in got[1, None].turns] == [("user", "hi"), ("user", "x")] and [t.text for t in got[1, 0].turns] == ["hi"]
    assert [(t.role, t.text) for t in got[1, 1].turns] == [("user", "hi"), ("assistant", "</turn>\\")] and got[1, 1].loss_text == "</turn>\\"
    assert [(t.role, t.text) for t in got[1, 3].turns] == [("user", "hi"), ("assistant", "better"), ("user", "")]
    assert [leaf for leaf, _ in sorted(((x[1], r.branch_rank) for x, r in got.items() if x[0] == 1), key=lambda y: y[1])] == [None, 3, 1, 0]
    assert [(r.conv_id, r.leaf) for r in chat_format.format_trees(df, best=1).where("conv_id = 1").collect()] == [(1, None)]
    deep = spark.createDataFrame([(1, i, i - 1 if i else None, "user", f"t{i}") for i in range(300)], "conv_id long, node long, parent long, role string, text string")
    assert [t.text for t in chat_format.read_back(chat_format.format_trees(deep)).first().turns] == [f"t{i}" for i in range(300)]
    assert chat_format.format_trees(deep.limit(0)).count() == 0


def test_every_turn_is_kept(spark, tmp_path):
    """Repeated turns, equal rows, null turns, roles and texts, and a very long text, as the SQL has it."""
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b<"), (1, 1, "assistant", "b<"), (1, 1, "assistant", "A"), (1, 2, None, None), (1, None, "assistant", "last"), (1, None, "assistant", None), (2, 5, "assistant", "x" * 2_000_000), (None, 0, "user", "no id"), (None, 0, "a>b", "c")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got, want = chat_format.query(spark, str(tmp_path)), con.sql(chat_format.SQL)
    assert sorted(repr(tuple(r)) for r in got.select(*want.columns).collect()) == sorted(repr(r) for r in want.fetchall())
    assert {r.conv_id: r.n_turns for r in got.collect()} == {1: 7, 2: 1, None: 2, -7: 2}


def test_trees_against_brute_force(spark):
    r = random.Random(4)
    rows = []
    for conv in range(20):
        for n in range(r.randrange(1, 14)):
            rows.append((conv, n, r.randrange(n) if n and r.random() < 0.9 else None, r.choice(["user", "assistant"]), f"t{n}", r.random()))
    df = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    by = {(c, n): (p, role, t, s) for c, n, p, role, t, s in rows}
    inner = {(c, p) for (c, _), (p, *_) in by.items() if p is not None}
    want = {}
    for c, n in by:
        if (c, n) not in inner:
            path, at = [], n
            while at is not None:
                path.append(by[c, at])
                at = by[c, at][0]
            path.reverse()
            want[c, n] = ([(x[1], x[2]) for x in path], sum(x[3] for x in path) / len(path), "".join(x[2] for x in path if x[1] == "assistant"))
    got = {(x.conv_id, x.leaf): x for x in chat_format.read_back(chat_format.format_trees(df)).collect()}
    assert set(got) == set(want)
    for k, (turns, score, loss) in want.items():
        assert [(t.role, t.text) for t in got[k].turns] == turns and abs(got[k].score - score) < 1e-9 and got[k].loss_text == loss
        assert got[k].branch_rank == 1 + sum(j[0] == k[0] and (-w[1], j[1]) < (-score, k[1]) for j, w in want.items())


def test_escapes_are_reversible(spark):
    r = random.Random(1)
    strings = ["".join(r.choice("\\bl<>g/turn:\n") for _ in range(40)) for _ in range(300)]
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    assert df.where(chat_format.unescape(chat_format.escape(F.col("s"))) != F.col("s")).isEmpty()


def groups(rows):
    """doc_id -> (set size, component), by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join_on_documents(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs).collect()}
    assert got == groups(texts.items())


def test_jaccard_join_on_a_chain_of_copies(spark, monkeypatch):
    """A large group in which only near relatives link, with and without pivots and salts."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):
        t = list(base)
        for _ in range(r.randrange(5)):
            t[r.randrange(120)] = f"v{r.randrange(10**6)}"
        rows.append((i * 3, " ".join(t)))
        if i % 11 == 0:
            base[r.randrange(120)] = f"u{i}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows)
    rounds, verify = [], jaccard_join.verify

    def counted(pairs, *more):
        rounds.append([tuple(r) for r in pairs.collect()])
        return verify(pairs, *more)

    monkeypatch.setattr(jaccard_join, "verify", counted)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similar_groups(df).collect()} == want
    pairs = [p for r in rounds for p in r]
    assert sum(map(bool, rounds)) > 1 and len(pairs) == len(set(pairs))  # several rounds, each pair in one
    monkeypatch.setattr(jaccard_join, "verify", verify)
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", 1)
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 1)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.similar_groups(df).collect()} == want
    kept = {x.doc_id for x in jaccard_join.keep_one(df).collect()}
    assert kept == {c for _, c in want.values()}


def test_jaccard_join_on_odd_rows(odd):
    got = collected(jaccard_join.similar_groups(odd).drop("key"))
    assert len(got) == odd.count()
    assert {(5, 977, 4), (1, 0, 1), (2, 0, 2), (None, 0, None), (None, 2, 7), (7, 1, 7)} <= set(got) and got.count((7, 2, 7)) == 2
    assert jaccard_join.similar_groups(odd.limit(0)).count() == 0
    kept = jaccard_join.keep_one(odd)
    assert kept.columns == odd.columns and all(r[c] == c for r in kept.collect() for c in CLASHES)
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 7, 7, 8, 9, 10]


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(200) if i % 50 != 49] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(120)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(find(k) == v for k, v in got.items())
    assert {k for k in root if find(k) != k} <= set(got)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_url_rules(spark):
    urls = ["http://a.b.ORG/x", "https://example.org/es/1", "https://www.example.org/en/12?x", "http://notexample.org/en/1", "http://x.com/fr/", "http://x.com/de/a#b", "http://x.com/fr", "nothing", None, "http://org", "http://org/", "a://b://c.org/://d"]
    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = [(r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.RULES).orderBy("page_id").collect()]
    assert got == [("a.b.org", "/x", "org/", "allow"), ("example.org", "/es/1", "example.org/es/", "block"), ("www.example.org", "/en/12", "example.org/en/1", "block"), ("notexample.org", "/en/1", "org/", "allow"), ("x.com", "/fr/", "com/fr/", "allow"), ("x.com", "/de/a", "com/de/", "block"), ("x.com", "/fr", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "", None, "allow"), ("org", "/", "org/", "allow"), ("b:", "//c.org/://d", None, "allow")]
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0
    assert url_filter.filter_urls(df, []).where("verdict <> 'allow'").isEmpty()


def test_long_urls_and_odd_rows(spark):
    import time

    trie = url_filter.build_trie([*url_filter.RULES, ("allow", "org", "/" + "y" * 40)])
    began = time.time()
    assert url_filter.match(trie, "example.org", "/en/1" + "x" * 2_000_000)[1] == "block"
    assert url_filter.match(trie, "a.org", "/" + "y" * 3_000_000)[0] == "org/" + "y" * 40
    assert url_filter.match(trie, ".".join(["a"] * 500_000) + ".com", "/de/" + "/" * 500_000)[1] == "block"
    assert time.time() - began < 2
    df = spark.createDataFrame([(None, "http://x.org/"), (1, "http://x.org/"), (1, "http://x.org/"), (2, "http://x.org/" + "a" * 2_000_000)], "page_id long, url string")
    assert [r.rule for r in url_filter.filter_urls(df, url_filter.RULES).collect()] == ["org/"] * 4


def test_repetitive_items_make_few_matches(spark):
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, "a b " * 40 + "x " + "a b " * 30)], "doc_id long, text string")
    items = spark.createDataFrame([("i", "word " * 500), ("j", "b a " * 20)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.judge(docs, items).collect()}
    assert (got[1].n_hit, got[1].items, got[2].n_hit, got[2].items) == (20_000, ["i"], 140, ["j"])
    assert len(got[1].matches) <= 20_000 / 400 and max(m.length for m in got[1].matches) == 500
    for d, text in ((1, ["word"] * 20_000), (2, ["a", "b"] * 40 + ["x"] + ["a", "b"] * 30)):
        for m in got[d].matches:
            item = ["word"] * 500 if m.item_id == "i" else ["b", "a"] * 20
            assert text[m.doc_start : m.doc_start + m.length] == item[m.item_start : m.item_start + m.length]


def test_decontamination_matches(spark, odd, monkeypatch):
    words = [f"t{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "Short Item"), (3, None), (4, "..."), (None, " ".join(words[5:30]))], "item_id long, text string")
    rows = [(1, "x y " + " ".join(words[3:20]) + " z"), (2, " ".join(words[3:15])), (3, "a SHORT, item b " * 3), (4, None), (5, ""), (6, " ".join(words) + " . " + " ".join(words))]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, matches string")
    got = {r.doc_id: r for r in decontaminate.judge(df, bench).collect()}
    assert sorted((m.item_id, m.item_start, m.doc_start, m.length) for m in got[1].matches) == [("", 0, 4, 15), ("1", 3, 2, 17)]
    assert (got[1].n_words, got[1].n_hit, got[2].n_hit, got[3].n_hit, got[3].items) == (20, 17, 0, 6, ["2"])
    assert (got[6].n_hit, got[6].items, got[4].n_words, got[5].contaminated) == (80, ["", "1"], 0, False)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    more = {r.doc_id: r for r in decontaminate.judge(df, bench).collect()}
    assert {i: (r.n_hit, r.items, r.contaminated) for i, r in more.items()} == {i: (r.n_hit, r.items, r.contaminated) for i, r in got.items()}
    monkeypatch.undo()
    assert sorted(r.doc_id for r in decontaminate.decontaminate(df, bench).collect()) == [2, 4, 5]
    clean = decontaminate.decontaminate(odd, bench)
    assert clean.count() == odd.count() and clean.columns == odd.columns and all(r[c] == c for r in clean.collect() for c in CLASHES)
    judged = decontaminate.judge(odd, bench).collect()
    assert {(r.doc_id, r.n_words, r.n_hit) for r in judged if r.doc_id in (1, 2, 4, 6, 8)} == {(1, 0, 0), (2, 0, 0), (4, 60_000, 0), (6, 1, 0), (8, 4, 0)}
    assert decontaminate.judge(odd, bench.limit(0)).where("contaminated").isEmpty()
    assert decontaminate.judge(odd.limit(0), bench).count() == 0


def check_packing(rows, want, capacity):
    """want: (doc_id, ids with the end) of each document."""
    by: dict = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    free = Counter((i, tuple(ids)) for i, ids in want)
    assert {i for i, _ in free} == set(by)
    for i, ids in want:
        if free[i, tuple(ids)] > 1 or sum(k[0] == i for k in free) > 1:
            continue
        own = sorted(by[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for n, r in enumerate(own):
            part = np.array(ids[at : at + r.length], "<u4")
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(part.tobytes()))
            assert r.length == capacity or n == 0
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs)


def test_packing(spark, docs, odd, texts, monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = [(i, [*t.encode(x, add_special_tokens=False).ids, 2]) for i, x in texts.items()]
    n = check_packing(packing.pack(docs, TOKENIZER).collect(), want, 1024)
    assert n <= -(-sum(len(x) for _, x in want) // 1024) * 1.05 + 1
    rows = [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in odd.select("doc_id", "text").collect()]
    monkeypatch.setattr(packing, "GROUPS_A_PARTITION", 3)
    check_packing(packing.pack(odd, TOKENIZER, 64).collect(), rows, 64)
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0


def test_long_white_space_is_packed(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    texts = [" " * 3_000_000, "\n" * 1_000_000, " \n" * 600_000 + "end", "x" * 500_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(packing.pack(df, TOKENIZER).collect(), [(i, [*t.encode(x, add_special_tokens=False).ids, 2]) for i, x in enumerate(texts)], 1024)


def test_plan_fills_well():
    r = random.Random(1)
    for _ in range(100):
        cap = r.choice([5, 64, 1024])
        h = {r.randint(1, cap): r.randint(1, 60) for _ in range(r.randint(1, 50))}
        got, end = Counter(), 0
        for length, first, n, seq, each, _ in packing.plan(h, cap):
            assert got[length] == first and n % each == 0
            got[length] += n
            end = max(end, seq + n // each)
        assert got == Counter(h)
        assert end <= 11 / 9 * -(-sum(k * n for k, n in h.items()) // cap) + sum(n for k, n in h.items() if 2 * k > cap) + 1


@pytest.fixture(scope="module")
def toxic_model(spark):
    more, marks = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.fit(more, marks)


def test_toxicity(spark, docs, labels, odd, toxic_model):
    more, marks = (spark.read.parquet(f"{MORE}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in toxicity.score(more, toxic_model).collect()}
    rows = [(r.doc_id, r.toxic) for r in marks.collect() if crc5(r.doc_id) == 0]
    assert sum(got[i].predicted == x for i, x in rows) / len(rows) >= 0.9
    out = toxicity.score(odd, toxic_model)
    assert out.where("predicted = 1").isEmpty()
    given = ("score", "predicted", "restored")
    assert out.columns == [c for c in odd.columns if c not in given] + ["score", "restored", "predicted"] and all(r[c] == c for r in out.collect() for c in CLASHES if c not in given)
    prior = {r.score for r in out.collect() if r.doc_id in (1, 2, 3)}
    assert len(prior) == 1
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels.limit(0))).count() == 0
    assert {r.score for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect()} == {0.5}


def test_channel_is_undone(toxic_model):
    r = toxicity.Restorer(toxic_model.lm)
    cases = {
        "id1ot": "idiot", "1d10t": "idiot", "idiot!": "idiot!", "i d i o t": "idiot", "i.d.i.o.t": "idiot", "idiooooot": "idiot", "l0$er": "loser", "stuuuupid": "stupid", "5tup1d": "stupid", "m-o-r-o-n": "moron",
        "$cum,": "scum,", "c  l  o  w  n": "clown", "c. l. o. w. n": "clown", "cl own": "clown", "clow n": "clown", "cc ll oo ww nn": "clown", "clown1": "clown1", "ÜBERIDIOT": "überidiot", "2024": "2024",
    }
    texts = [f"so {c} then".lower() for c in cases]
    got, changed = r.restore(texts)
    assert got == [f"so {x} then" for x in cases.values()]
    assert [len(x) for x in changed] == [int(a != b) for a, b in zip(texts, got, strict=True)]


def test_most_text_is_left_alone(docs, toxic_model):
    texts = [(r.text or "").lower() for r in docs.collect()]
    got, changed = toxicity.Restorer(toxic_model.lm).restore(texts)
    words = sum(len(t.split()) for t in texts)
    assert sum(len(x) for x in changed) < 0.005 * words
    for t, g, c in zip(texts, got, changed, strict=True):
        assert c or t == g


def test_spans_against_decoding_every_text(toxic_model):
    """What numpy leaves alone has no sign among letters, no triple letter and no row of single letters."""
    r = random.Random(8)
    texts = ["".join(r.choice("abeilot10$! .\n") for _ in range(60)) for _ in range(200)]
    c, at = toxicity.code_points(texts)
    starts, ends = toxicity.suspicious_spans(c, toxic_model.lm)
    inside = np.zeros(len(c) + 1, int)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside)
    for i, t in enumerate(texts):
        for m in re.finditer(r"([a-z])\1\1|(?<=[a-z])[01](?=[a-z])|(?<=[a-z])[$!](?=[a-z])|\b[a-z] [a-z] [a-z]\b(?![01$!])", t):
            if m[0][0] in "01$!" or len(m[0]) == 3 or not re.search("[01$!]", t[max(0, m.start() - 1) : m.end() + 1]):
                assert inside[at[i] + m.start() : at[i] + m.end()].all() or " " in m[0] and inside[at[i] + m.start()], (t, m[0])


def test_regression_against_plain_steps():
    rng = np.random.default_rng(3)
    x = (rng.random((60, 5)) < 0.4) * rng.random((60, 5))
    y, w = (x[:, 0] + 0.2 * rng.random(60) > 0.3).astype(float), rng.random(60) + 0.5
    rows, cols = np.nonzero(x)
    got, bias = toxicity.regression(rows, cols, x[rows, cols], y, w, 5)
    z, b = np.zeros(5), 0.0
    for _ in range(200_000):
        slack = w / w.sum() * (1 / (1 + np.exp(-(x @ z + b))) - y)
        z, b = z - 1.5 * (x.T @ slack + toxicity.RIDGE * z), b - 1.5 * slack.sum()
    loss = lambda z, b: (w / w.sum() * (np.logaddexp(0, x @ z + b) - y * (x @ z + b))).sum() + toxicity.RIDGE / 2 * (z @ z)
    assert loss(got, bias) < loss(z, b) + 2e-3


def test_features_against_a_loop():
    texts = ["", "Aé bc, abcdef!", "x1y abc abc"]
    h, owner = toxicity.features([t.lower() for t in texts])
    for i, t in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", t.lower())
        assert (owner == i).sum() == len(words) + sum(max(0, min(8, len(w)) - 2) for w in words)
    owner, f, n = toxicity.counted(h, owner)
    assert sorted(n[owner == 2].tolist()) == [1, 1, 2, 2]
