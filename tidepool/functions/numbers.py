"""Columns over confidences, percentages, run states and model outputs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def safe_float(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(text.cast("string")).try_cast("double"), F.lit(default))


def safe_int(text: Column, default: int = 0) -> Column:
    """Of whole numbers written as such; anything else is the default."""
    t = F.trim(text.cast("string"))
    return F.when(t.rlike("^[+-]?[0-9]+$"), F.coalesce(t.try_cast("long"), F.lit(default))).otherwise(F.lit(default))


def scale_confidence(c: Column) -> Column:
    return F.round(c * 100, 2)


def progress(value: Column) -> Column:
    return clamp(value.cast("int"), 0, 100)


def progress_pct(done: Column, total: Column) -> Column:
    """20 to 95 while batches are embedded."""
    return F.when(total > 0, clamp(F.lit(20) + F.floor(F.lit(75) * done / total), 0, 100)).otherwise(F.lit(20)).cast("int")


def percent_text(value: Column, total: Column) -> Column:
    return F.when(total > 0, F.concat(F.format_string("%.1f", F.round(value * 100.0 / total, 1)), F.lit("%"))).otherwise("0.0%")


def bar_width(value: Column, total: Column) -> Column:
    return F.when(total > 0, clamp(value * 100.0 / total, 2, 100)).otherwise(F.lit(2.0))


def normalize_status(status: Column, success: Column) -> Column:
    return F.coalesce(F.nullif(status, F.lit("")), F.when(F.coalesce(success, F.lit(False)), "completed").otherwise("failed"))


def strict_status(status: Column) -> Column:
    """Unknown states are failures."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.isin("completed", "failed", "running", "queued", "pending"), s).otherwise("failed")


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def argmax(values: Column) -> Column:
    """Place from 0 of the first largest value."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def top_k(labels: Column, probabilities: Column, k: int = 3) -> Column:
    """The k likeliest (label, p); ties keep the labels' order."""
    pairs = F.transform(probabilities, lambda p, i: F.struct((-p).alias("m"), i.alias("i"), F.get(labels, i).alias("label"), p.alias("p")))
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda x: F.struct(x["label"].alias("label"), x["p"].alias("p")))
