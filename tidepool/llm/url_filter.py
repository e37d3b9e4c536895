"""URL allow and block rules, matched in a trie of reversed host labels and path segments.

``com/fr/`` becomes com -> (path) fr -> "". The trie walks the labels of a url's host from the
right; at each label it may turn into the path. A rule's last path segment need only begin the
url's, so ``/en/1`` also fits ``/en/12``. The rule with the most host labels wins, and of those the
one with the longest path. No rule: the default verdict.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Characters of all rules together; they are given in a call or a file, not derived from data.
MAX_RULE_CHARS = 64_000_000
PATH, LAST, LONGEST = 0, 1, 2  # keys of a trie node that aren't labels


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Of (verdict, host, path) rules. Of equal rules the block one stays."""
    trie: dict = {}
    size = 0
    for verdict, host, path in sorted(rules, key=lambda r: r[0] == "block"):
        size += len(host) + len(path)
        if size > MAX_RULE_CHARS:
            raise ValueError("too many rules to broadcast")
        node = trie
        for label in reversed(host.lower().split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(PATH, {})
        *inner, last = path.split("/")
        for segment in inner:
            node = node.setdefault(segment, {})
        node.setdefault(LAST, {})[last] = (f"{host.lower()}{path}", verdict)
        node[LONGEST] = max(node.get(LONGEST, 0), len(last))
    return trie


def in_path(node: dict, path: str):
    """The rule with the longest path that begins the given one."""
    best, segments = None, path.split("/")
    for segment in segments:
        ends = node.get(LAST)
        if ends:
            for n in range(min(len(segment), node[LONGEST]), -1, -1):
                if segment[:n] in ends:
                    best = ends[segment[:n]]
                    break
        node = node.get(segment)
        if node is None:
            break
    return best


def match(trie: dict, host: str, path: str):
    """(rule, verdict) or None."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if PATH in node:
            best = in_path(node[PATH], path) or best
    return best


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (null if none fits) and verdict of every row.

    A null url or one without ``://`` has an empty host and path, fits no rule and gets the
    default. Repeated rows are judged each by itself; other columns are not read. No shuffle: the
    trie goes to every executor once, its size is bounded by MAX_RULE_CHARS.
    """
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches):
        import pyarrow as pa

        t = trie.value
        for b in batches:
            found = [match(t, h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, rule, verdict], [*b.schema.names, "rule", "verdict"])

    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = pages.select(F.col(key).alias(key), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.regexp_extract(url, parts, 2), F.lit("")).alias("path"))
    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string")


#: The rules of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


SQL = r"""
WITH parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY len(h) DESC NULLS LAST, len(p) DESC) AS n
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict FROM fits WHERE n = 1
"""
