"""Columns over taxonomy labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RANKS, UNKNOWN

PREFIX = {r[0]: r for r in RANKS}


def parse_taxonomy(label: Column) -> Column:
    """A struct of the seven ranks.

    With a ``;`` the label is split there, else at white space; blank parts are dropped. ``x__v``
    sets the rank that begins with x (the last one given counts); with another prefix, v is
    positional. Positional values go to the ranks from kingdom down and win over prefixed ones. What
    nothing sets, and an empty v, is Unknown.
    """
    whole = F.trim(F.coalesce(label, F.lit("")), F.lit(" \t\n\r\x0b\x0c"))
    parts = F.when(whole.contains(";"), F.split(whole, ";")).otherwise(F.split(whole, "\\s+"))
    parts = F.filter(F.transform(parts, lambda p: F.trim(p, F.lit(" \t\n\r\x0b\x0c"))), lambda p: p != "")
    prefix = lambda p: F.lower(F.trim(F.substring_index(p, "__", 1)))
    value = lambda p: F.coalesce(F.nullif(F.trim(F.regexp_replace(p, "(?s)^.*?__", "")), F.lit("")), F.lit(UNKNOWN))
    named = lambda p: p.contains("__") & prefix(p).isin(*PREFIX)
    placed = F.transform(F.filter(parts, lambda p: ~named(p)), lambda p: F.when(p.contains("__"), value(p)).otherwise(p))
    out = []
    given = lambda rank: F.transform(F.filter(parts, lambda p: named(p) & (prefix(p) == rank[0])), value)
    for i, rank in enumerate(RANKS):
        own = given(rank)
        out.append(F.coalesce(F.get(placed, F.lit(i)), F.element_at(F.when(F.size(own) > 0, own), -1), F.lit(UNKNOWN)).alias(rank))
    return F.struct(*out)


def split_binomial(name: Column) -> Column:
    """Species name -> ranks: genus is its first word, species its first two (or all of it)."""
    words = F.filter(F.split(F.trim(name), "\\s+"), lambda w: w != "")
    genus = F.coalesce(F.get(words, F.lit(0)), F.lit(UNKNOWN))
    species = F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), " ")).otherwise(F.coalesce(F.nullif(name, F.lit("")), F.lit(UNKNOWN)))
    fixed = {"kingdom": F.lit("Bacteria"), "genus": genus, "species": species}
    return F.struct(*[fixed.get(r, F.lit(UNKNOWN)).alias(r) for r in RANKS])


def otu_label(cluster: Column) -> Column:
    return F.format_string("OTU-%03d", cluster + 1)


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(UNKNOWN))
