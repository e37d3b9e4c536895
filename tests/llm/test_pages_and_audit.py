"""HTML extraction and the filter audit against plain code, and on awkward tables."""

import re
from collections import Counter
from html import unescape
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import filter_audit, html_extract
from tidepool.llm.html_extract import main_text

DIR = "/root/testdata/sf0.01"


def article(html):
    """The article of a page of the test tables, cut by patterns that know their template."""
    inner = re.search(r"<article>(.*)</article>", html, re.S)[1]
    lines = (" ".join(unescape(re.sub(r"<[^>]*>", "", s)).split()) for s in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
    return "\n".join(x for x in lines if x)


def test_every_page_gives_its_article(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    want = sorted((r.page_id, r.url, t := article(r.html), len(t)) for r in pages.collect())
    assert sorted(map(tuple, html_extract.query(spark, DIR).collect())) == want


PARAGRAPHS = "<p>The first paragraph has a good number of words, some commas, and goes on for quite a while until it ends.</p><p>The second is <b>longer</b>, or nearly so;<br>it has a line break, a <a href=/x>link</a>, and &quot;quotes&quot; too.</p>"
TEXT = 'The first paragraph has a good number of words, some commas, and goes on for quite a while until it ends.\nThe second is longer, or nearly so; it has a line break, a link, and "quotes" too.'


@pytest.mark.parametrize(
    "html, want",
    [
        # nothing but divs: ratios decide
        (f"<div id=w><div>A site</div><div><a href=/>Home</a> <a href=/n>News</a></div><div><h2>T &amp; t</h2>{PARAGRAPHS}<ul><li>one</li><li>two</ul></div><div>All rights reserved.</div></div>", f"T & t\n{TEXT}\none\ntwo"),
        # boilerplate that says so, inside the article and outside
        (f"<body class='has-sidebar'><header><h1>Site</h1></header><main><header class=post-header><h1>T</h1><p>by me</p></header>{PARAGRAPHS}<aside>more, of this; and that. And so on, for ever.</aside><form><input><p>mail?</form><div id=comments><p>{'I like it, much. ' * 20}</div></main><div class='cookie-notice'>{'We use them, all. ' * 30}</div>", f"T\n{TEXT}"),
        ("<nav><a>x</a></nav><article><h1>Foo</h1><p><b>Foo<br></article><div class=ad>Buy it now, please. It is cheap.</div>", "Foo\nFoo"),
        ("<title>t</title><script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no --><p>a < b &amp;amp; c &eacute;&#233;&#x20AC; 1&nbsp;2</p>", "a < b &amp; c éé€ 1 2"),
        (f"<body><form action=x>{PARAGRAPHS}<p>Third.</form>", f"{TEXT}\nThird."),
        ("<article><p>one<p>two<table><tr><td>a<td>b<tr><td>c</table></article></article></b>tail", "one\ntwo\na\nb\nc"),
        (f"<article>{PARAGRAPHS}<p>cut off <a href='", f"{TEXT}\ncut off"),
        ("no tags at all\n  but   white space", "no tags at all but white space"),
        ("<nav><a href=x>only a menu</a></nav>", ""), ("", ""), (None, ""), ("<p>\n \t</p>", ""),
    ],
)
def test_pages_of_other_kinds(html, want):
    assert main_text(html) == want


def test_ratios_tell_unmarked_blocks():
    """Without any telling name or element, the many long paragraphs win over many short lines around them."""
    body = "".join(f"<p>Sentence {i} of the story, which goes on, and has signs; it ends here at last.</p>" for i in range(12))
    page = f"<div><div>{''.join(f'<span>word{i}</span><br>' for i in range(9))}</div><div><h3>Title</h3>{body}<p>End.</p></div><div>{''.join(f'<div>x{i} y</div>' for i in range(9))}</div></div>"
    assert main_text(page).split("\n") == ["Title", *[f"Sentence {i} of the story, which goes on, and has signs; it ends here at last." for i in range(12)], "End."]


@pytest.mark.parametrize("html", ["<div><b>" * 20_000 + "x", "<a '" * 50_000 + "x", "</b></div></p>x" * 20_000, "<" * 300_000, "<a" * 100_000, "x " * 1_000_000, "<ul><li>" * 20_000 + "x"])
def test_large_and_broken_pages_take_linear_time(html):
    assert isinstance(main_text(html), str)


def test_awkward_page_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string, _html string"
    rows = spark.createDataFrame([(1, None, None, "q", "q", "q"), (None, "u", "<p>x</p>", "q", "q", "q"), (2, "u", "<p>x</p>", "q", "q", "q"), (2, "u", "<p>x</p>", "q", "q", "q"), (3, "", "", None, None, None)], schema)
    got = sorted(map(tuple, html_extract.extract(rows.drop("text", "n_chars"), "page_id", "url").collect()), key=repr)
    assert got == sorted([(1, None, "", 0), (None, "u", "x", 1), (2, "u", "x", 1), (2, "u", "x", 1), (3, "", "", 0)], key=repr)
    assert html_extract.extract(rows, "page_id").count() == 5
    assert html_extract.extract(rows.limit(0), "page_id", "url").count() == 0


def brute_audit(docs, labels):
    """Every order applied to every document, one filter after the other."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    failed = []
    for i, t, s in docs:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        bad = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        failed.append((s or "", {f for f in bad if bad[f]}, *labels.get(i, (0, 0))))
    out, shapley = {}, Counter()
    for part in {x[0] for x in failed}:
        own = [x for x in failed if x[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                before, left = left, [x for x in left if f not in x[1]]
                shapley[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[1] for x in own) - sum(f in x[1] for x in before), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = {r.doc_id: (r.quality == 1, r.toxic == 1) for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    got = filter_audit.query(spark, DIR)
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute_audit(docs, labels)


def test_audit_of_odd_rows(spark, tmp_path):
    long = "Word " * 30_000
    rows = [(1, None, "a"), (2, "", "a"), (3, "", None), (None, "", "a"), (None, None, ""), (4, long, "b"), (5, long, "b"), (5, long, "b"), (4, long, "a"), (6, "# x", "b"), (7, "w" * 300_000, "c"), (8, " \n\t", "c"), (9, " ".join(map(str, range(300))), "c")]
    docs = spark.createDataFrame([(*r, "1", "2", "3") for r in rows], "doc_id long, text string, source string, part string, n string, A string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, None), (1, 0, 1), (5, None, 1), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = filter_audit.query(spark, str(tmp_path))
    assert sorted(map(tuple, got.select(COLUMNS).collect())) == brute_audit(rows, {1: (1, 1), 5: (0, 1)})
    assert filter_audit.failures(docs.limit(0)).count() == 0
    assert filter_audit.audit(filter_audit.failures(docs.limit(0)), "ABCDE").count() == 0


def test_removal_steps_are_first_failures():
    orders, step, position = filter_audit.removal_steps(4)
    for m in range(16):
        for o, order in enumerate(orders):
            want = next((s for s, f in enumerate(order) if m >> f & 1), filter_audit.NEVER)
            assert step[m, o] == want
    assert all(position[o, f] == orders[o].index(f) for o in range(24) for f in range(4))
    assert np.all(step[0] == filter_audit.NEVER)


def test_audit_of_named_filters(spark):
    rows = spark.createDataFrame([("x", True, None, 2, 5), ("x", True, True, 1, None), ("x", False, False, 3, 1), (None, False, True, 1, 1)], "part string, short boolean, odd boolean, n long, bad long")
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(rows, ["short", "odd"], ["bad"]).collect()}
    assert len(got) == 8
    r = got["x", "shortodd", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.lost_bad, r.shapley) == (3, 0, 1, 0, 0, 1)
    assert got["x", "shortodd", 1].lost_bad == 10 and got[None, "oddshort", 1].removed == 1
    with pytest.raises(ValueError):
        filter_audit.audit(rows.select("part", "n", F.lit(True).alias("a")), ["a"] * 7)
