"""Main text of web pages by tag-path ratios.

A page is a row of text nodes, each at the end of a path of tags from the root. Nodes with one path
are set alike by a page's template, so a path is judged as a whole: by its text a node, and by its
punctuation a node. Both ratios are fused into one weight, which is smoothed over the page's nodes
in their order and averaged again for each path. Paths that reach a share of the page's best smoothed
weight hold the content; the smallest element that has (nearly) all of their text is the article, and what
lies in it is kept, but for parts that say what they are (menus, asides, forms, comments and the like).
Nothing is learned and nothing is shuffled: a page is judged by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Elements without content, elements whose content is no text, and elements within a line of text (HTML's own lists).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Start tags that end an open p, and open elements that a start tag of their group ends.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
P, ROOTS, P_STOPS, SIBLING_STOPS = frozenset(["p"]), frozenset(["html", "body"]), frozenset("button table td th".split()), frozenset("table ul ol dl menu select".split())
#: An implied end goes no farther up than these.
SCOPE = frozenset("html body table td th ul ol dl div section article main aside nav header footer form template".split())
#: Elements that are no main text by their kind, and words of a class, id or role that say the same.
BOILERPLATE = frozenset("nav footer aside form menu button select dialog object audio video canvas head".split())
MARKERS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation"
    " newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond responses search share sharing sidebar signup skyscraper social sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
#: A header of these is the article's own.
OWN_HEADER, NONE = frozenset("article entry post story".split()), frozenset()
#: Elements that say that they hold the main text; those are never taken for boilerplate by a class.
MAIN = frozenset(["article", "main"])
NEVER_MARKED = MAIN | {"html", "body"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What is a piece of text and never the article.
PIECES = INLINE | HEADINGS | frozenset("p li td th tr dd dt blockquote pre".split())
#: Weights of text in a main element and in a link; share of the page's best smoothed weight that a path needs; share of the
#: chosen text that the article has to hold; weights of the neighbours at distance 1 and 2; paragraphs of a form that is a page.
MAIN_WEIGHT, LINK_WEIGHT, LEAST_SHARE, ARTICLE_SHARE, KERNEL, FORM_PARAGRAPHS = 4.0, 0.1, 0.35, 0.97, (0.6, 0.2), 3

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")


@dataclass(slots=True)
class Page:
    """Elements by number, parents before their children; number 0 is the page. Text nodes are triples of
    element, block and text (references decoded)."""

    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    #: Number of the path from the root, and its length.
    paths: list[int] = field(default_factory=lambda: [0])
    depths: list[int] = field(default_factory=lambda: [0])
    #: Whether the class, id or role says boilerplate, and whether it says main text.
    marked: list[bool] = field(default_factory=lambda: [False])
    main: list[bool] = field(default_factory=lambda: [False])
    nodes: list[tuple[int, int, str]] = field(default_factory=list)


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)}


def parse(html: str) -> Page:
    """Elements and text nodes of a page. End tags that HTML lets one leave out are supplied, misnested
    ones are ignored, and a page that stops in the middle is closed. Neither scripts, styles nor comments
    have text nodes. A block ends where an element begins or ends that isn't part of a line."""
    page = Page()
    tags, nodes, stack = page.tags, page.nodes, [0]
    known: dict[tuple[int, str], int] = {}
    opened: dict[str, int] = {}
    block, at, end = 0, 0, len(html)

    def pop(ends: frozenset[str], stop: frozenset[str]) -> bool:
        """Close the innermost open element of these tags, unless one of stop lies above it."""
        if not any(opened.get(t) for t in ends):
            return False
        for i in range(len(stack) - 1, 0, -1):
            tag = tags[stack[i]]
            if tag in ends:
                for j in stack[i:]:
                    opened[tags[j]] -= 1
                del stack[i:]
                return True
            if tag in stop:
                return False
        return False

    while at < end:
        m = TOKEN.search(html, at)
        if m is None or m.start() > at:
            nodes.append((stack[-1], block, unescape(html[at : m.start() if m else end])))
        if m is None:
            break
        at = m.end()
        closes, name, source, closed = m.group(1, 2, 3, 4) if m[2] else m.group(5, 6, 7, 8)
        if not name:
            continue
        if not closed:  # a tag that the page's end cuts off
            break
        tag = name.lower()
        inline = tag in INLINE
        if not inline:
            block += 1
        if closes:
            pop(frozenset([tag]), frozenset() if tag in SCOPE else SCOPE if inline or tag == "p" else ROOTS)
            continue
        if tag in RAW:
            if not (source.endswith("/") and tag in ("svg", "math")):
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = close.end() if close else end
            continue
        if tag in ENDS_P:
            pop(P, P_STOPS)
        if tag in SIBLINGS:
            while pop(SIBLINGS[tag], SIBLING_STOPS):
                pass
        if tag in VOID:
            if tag == "br":
                nodes.append((stack[-1], block, " "))
            continue
        parent, label, marked, main = stack[-1], tag, tag == "header", tag in MAIN
        if source and (own := attributes(source)):
            label = f"{tag}.{'.'.join(sorted(own.get('class', '').split()))}"
            hints = {w.lower() for k in ("class", "id", "role") if k in own for w in WORD.findall(own[k])}
            marked = marked or tag not in NEVER_MARKED and (bool(hints & MARKERS) or "header" in hints and not hints & OWN_HEADER)
            main = main or own.get("role") == "main" or own.get("itemprop") == "articleBody"
        stack.append(len(tags))
        opened[tag] = opened.get(tag, 0) + 1
        tags.append(tag)
        page.parents.append(parent)
        page.paths.append(known.setdefault((page.paths[parent], label), len(known) + 1))
        page.depths.append(page.depths[parent] + 1)
        page.marked.append(marked)
        page.main.append(main)
    return page


def properties(page: Page) -> tuple[list[bool], list[bool], list[bool]]:
    """Of each element: whether it is boilerplate or lies in some, in a main element, in a link of a line.

    An element that holds a main one is no boilerplate, nor is a form with several paragraphs; the
    headings in a main element's header aren't either.
    """
    tags, parents = page.tags, page.parents
    n = len(tags)
    holds, paragraphs = page.main.copy(), [0] * n
    for i in range(n - 1, 0, -1):
        holds[parents[i]] |= holds[i]
        paragraphs[parents[i]] += paragraphs[i] + (tags[i] == "p")
    out, inside, linked = [False] * n, [False] * n, [False] * n
    for i in range(1, n):
        tag, up = tags[i], parents[i]
        inside[i] = inside[up] or page.main[i]
        linked[i] = tag == "a" or tag in INLINE and linked[up]
        if tag in HEADINGS and tags[up] == "header" and inside[up]:
            out[i] = out[parents[up]]
        else:
            out[i] = out[up] or not holds[i] and (page.marked[i] or tag in BOILERPLATE and not (tag == "form" and paragraphs[i] >= FORM_PARAGRAPHS))
    return out, inside, linked


def path_weights(paths: np.ndarray, lengths: np.ndarray, marks: np.ndarray, boost: np.ndarray) -> np.ndarray:
    """The smoothed weight of each node's path. Nodes come in page order."""
    _, of = np.unique(paths, return_inverse=True)
    n = np.bincount(of)
    text, signs = np.bincount(of, lengths) / n, np.bincount(of, marks) / n
    fused = (text * (1 + signs))[of] * boost
    wide = np.zeros(len(fused) + 4)
    wide[2:-2] = fused
    near, far = KERNEL
    smooth = (fused + near * (wide[1:-3] + wide[3:-1]) + far * (wide[:-4] + wide[4:])) / (1 + 2 * near + 2 * far)
    return (np.bincount(of, smooth) / n)[of]


def main_text(html: str | None) -> str:
    """The main text of one page: blocks in page order, each with its white space as single spaces, joined
    by line ends. A null or empty page, or one that is all boilerplate, has an empty text."""
    page = parse(html or "")
    out, inside, linked = properties(page)
    nodes = [x for x in page.nodes if not out[x[0]]]
    full = [(e, s) for e, _, t in nodes if (s := t.strip())]
    if not full:
        return ""
    at = np.array([e for e, _ in full])
    lengths = np.array([len(s) for _, s in full], float)
    marks = np.array([len(PUNCTUATION.findall(s)) for _, s in full], float)
    boost = np.where(np.array(inside)[at], MAIN_WEIGHT, 1.0) * np.where(np.array(linked)[at], LINK_WEIGHT, 1.0)
    weights = path_weights(np.array(page.paths)[at], lengths, marks, boost)
    held = np.bincount(at, np.where(weights >= LEAST_SHARE * weights.max(), lengths * weights, 0), len(page.tags)).tolist()
    for i in range(len(held) - 1, 0, -1):
        held[page.parents[i]] += held[i]
    # the article: the deepest element that holds nearly all chosen text and isn't a piece of text itself
    article = max((i for i, x in enumerate(held) if x >= ARTICLE_SHARE * held[0] and page.tags[i] not in PIECES), key=page.depths.__getitem__)
    up = article
    while up and not page.main[up]:
        up = page.parents[up]
    article = up or article  # a main element is taken whole
    within = [False] * len(held)
    for i in range(len(held)):
        within[i] = i == article or i > 0 and within[page.parents[i]]
    blocks: dict[int, list[str]] = {}
    spoken: set[int] = set()  # blocks that have more than links
    for e, b, t in nodes:
        if within[e]:
            blocks.setdefault(b, []).append(t)
            if inside[e] or not linked[e] and not t.isspace():
                spoken.add(b)
    # outside of a main element, a line that is nothing but links is a menu's
    lines = (" ".join("".join(parts).split()) for b, parts in blocks.items() if b in spoken)
    return "\n".join(s for s in lines if s)


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``pages`` (html among its columns), text and n_chars (code points, long).

    One row for each row, repeated ones too. A null or empty html has an empty text; pages of any length
    are read whole; other columns are not read and may have any name. Without rows the result is empty.
    """
    schema = T.StructType([*[pages.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(*keep, F.col("html").alias("_html")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), "page_id", "url")
