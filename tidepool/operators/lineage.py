"""Taxonomy joins: lineages, label overrides, hits, consensus, nearest neighbours."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clamp
from ..functions.taxonomy import or_unknown, parse_taxonomy
from ..schema import RANKS, UNKNOWN
from ..storage import kept, scratch, written
from .neighbours import nearest


def resolve_lineage(taxids: DataFrame, nodes: DataFrame, names: DataFrame, top: tuple[str, ...] = ("superkingdom",)) -> DataFrame:
    """taxid and the seven ranks of each distinct taxid, by walking parents to the root.

    Where a rank repeats on the way the node nearest the root counts; a cycle ends the walk; names that
    are missing, and ranks not met, are Unknown. ``top``: ranks that count as kingdom.
    All walks go up one step in each round, as an equi-join of those still under way.
    """
    rank = F.when(F.col("rank").isin(*top), "kingdom").otherwise(F.col("rank"))
    tree = nodes.select(F.col("taxid").alias("at"), "parent", rank.alias("rank")).join(names.select(F.col("taxid").alias("at"), "name"), "at", "left")
    all_ids = taxids.select("taxid").distinct()
    with scratch():
        tree = written(tree.select("at", "parent", "rank", F.coalesce("name", F.lit(UNKNOWN)).alias("name")), "tree")
        front = all_ids.select("taxid", F.col("taxid").alias("at"), F.array().cast("array<int>").alias("seen"))
        levels = []
        for depth in count():  # each round adds a node to every walk, and a node seen before ends it
            step = written(front.join(tree, "at").select("taxid", "at", "parent", "rank", "name", "seen", F.lit(depth).alias("depth")), "walk")
            if step.isEmpty():
                break
            levels.append(step.where(F.col("rank").isin(*RANKS)).select("taxid", "rank", "name", "depth"))
            seen = F.concat("seen", F.array("at"))
            front = step.where((F.col("parent") != 0) & ~F.array_contains(seen, F.col("parent"))).select("taxid", F.col("parent").alias("at"), seen.alias("seen"))
        if not levels:
            return all_ids.withColumns({r: F.lit(UNKNOWN) for r in RANKS})
        walked = reduce(DataFrame.unionByName, levels)
        best = walked.groupBy("taxid").agg(*[F.max_by(F.when(F.col("rank") == r, F.col("name")), F.when(F.col("rank") == r, F.col("depth"))).alias(r) for r in RANKS])
        best = kept(best, "lineages")
    return all_ids.join(best, "taxid", "left").select("taxid", *[F.coalesce(F.col(f"`{r}`"), F.lit(UNKNOWN)).alias(r) for r in RANKS])


def attach_lineage(df: DataFrame, lineage: DataFrame, key: str = "taxid") -> DataFrame:
    """Rows without a lineage stay, all ranks Unknown."""
    out = df.join(lineage, key, "left")
    return out.withColumns({r: or_unknown(F.col(f"`{r}`")) for r in RANKS})


def with_ranks(df: DataFrame, label: str = "predicted_label") -> DataFrame:
    return df.withColumn("_t", parse_taxonomy(F.col(label))).select(*df.columns, "_t.*")


def apply_label_taxonomy(df: DataFrame, known: DataFrame, label: str = "predicted_label") -> DataFrame:
    """Ranks from ``known`` (label, ranks) where it has the label, else parsed from the label."""
    k = known.select(F.col("label").alias("_label"), F.struct(*RANKS).alias("_k"))
    out = df.join(k, F.col(label) == F.col("_label"), "left")
    return out.withColumn("_t", F.coalesce("_k", parse_taxonomy(F.col(label)))).select(*df.columns, "_t.*")


def mask_low_confidence(df: DataFrame, threshold: float, confidence: str = "confidence") -> DataFrame:
    """All ranks Unknown below the threshold; confidence (0 to 1) and label stay."""
    low = F.col(confidence) < clamp(F.lit(float(threshold)), 0.0, 1.0)
    return df.withColumns({r: F.when(low, F.lit(UNKNOWN)).otherwise(F.col(f"`{r}`")) for r in RANKS})


def clean_reference_taxonomy(df: DataFrame, sub_ranks: DataFrame, label: str = "label", key: str = "id") -> DataFrame:
    """(key, taxonomy): from ``Root`` on, blanks as ``_``, without tabs, quotes, a trailing
    ``*_incertae_sedis``, the ``Root;`` head and every name of ``sub_ranks`` (name); ends with ``;``."""
    c = F.regexp_replace(F.col(label), "^.*?(?=Root)", "")
    c = F.translate(F.regexp_replace(c, "\t", ""), " ", "_")
    c = F.regexp_replace(F.regexp_replace(c, "\"|'", ""), ";[^;]*_incertae_sedis;?$", "")
    parts = df.select(key, F.posexplode(F.filter(F.split(c, ";"), lambda p: (p != "") & (p != "Root"))).alias("pos", "name"))
    kept = parts.join(sub_ranks.select("name").distinct(), "name", "left_anti")
    joined = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("p"))
    return joined.select(key, F.concat(F.array_join(F.transform("p", lambda x: x["name"]), ";"), F.lit(";")).alias("taxonomy"))


def attach_samples(reads: DataFrame, manifest: DataFrame, path: str = "file") -> DataFrame:
    """Reads with the sample and mate of their file; reads of files that the manifest doesn't name go.

    manifest: sample_id, mate, path. Paths are compared by their last part, as manifests name files
    relative to their own place.
    """
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    files = manifest.select("sample_id", "mate", last("path").alias("_file")).distinct()
    return reads.withColumn("_of", last(path)).join(files, F.col("_of") == F.col("_file")).drop("_of", "_file")


def taxonomy_from_hits(hits: DataFrame, lineage: DataFrame, least_identity: float = 0.0, most_evalue: float = 10.0) -> DataFrame:
    """The best hit of each query (identity, then e-value, then subject) with the lineage of its first taxid."""
    ok = hits.where((F.col("pident") >= least_identity) & (F.col("evalue") <= most_evalue))
    best = ok.groupBy("query_id").agg(F.min_by(F.struct("subject_id", "staxids", "pident", "evalue"), F.struct(-F.col("pident"), "evalue", "subject_id")).alias("h")).select("query_id", "h.*")
    return attach_lineage(best.withColumn("taxid", F.substring_index("staxids", ";", 1).try_cast("int")), lineage)


def consensus(preds: DataFrame, weights: DataFrame, least_share: float = 0.5) -> DataFrame:
    """sequence_id, the seven ranks, share: a weighted vote at each rank across methods. A rank holds
    if its winner has more than ``least_share`` of the weight and all ranks above hold; below, Unknown.

    preds: sequence_id, method, ranks; weights: method, weight. Ties go to the first name.
    """
    rows = preds.join(F.broadcast(weights), "method")
    # a sequence has a row for each method, so its votes are one short list and move once
    row = F.struct("weight", *[or_unknown(F.col(f"`{r}`")).alias(r) for r in RANKS])
    lists = rows.groupBy("sequence_id").agg(F.collect_list(row).alias("v"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x["weight"])

    def top(r: str):
        names = F.array_distinct(F.transform("v", lambda x: x[r]))
        best = F.array_min(F.transform(names, lambda t: F.struct((-total(F.filter("v", lambda x: x[r] == t))).alias("m"), t.alias("taxon"))))
        return F.struct((-best["m"] / total(F.col("v"))).alias("s"), best["taxon"].alias("taxon"))

    one = lists.select("sequence_id", F.array(*[top(r) for r in RANKS]).alias("t"))
    bad = F.transform("t", lambda x: (x["s"] <= least_share) | (x["taxon"] == UNKNOWN))
    at = F.array_position(bad, True)
    one = one.withColumn("depth", F.when(at > 0, at - 1).otherwise(len(RANKS)).cast("int"))
    ranks = [F.when(F.col("depth") > i, F.get("t", F.lit(i))["taxon"]).otherwise(UNKNOWN).alias(r) for i, r in enumerate(RANKS)]
    return one.select("sequence_id", *ranks, F.round(F.get("t", F.greatest(F.col("depth") - 1, F.lit(0)))["s"], 6).alias("share"))


def knn_classify(queries: DataFrame, reference: DataFrame, k: int = 5, max_distance: float | None = None, others: bool = False, probes: int | None = None) -> DataFrame:
    """sequence_id, ranks, confidence (100 x votes of the winner / k), method, predicted_label and
    closest_distance. The winner of equal votes is the nearer one, then the first by name; without
    a neighbour within max_distance the label is Unknown and the confidence 0. ``probes``: lists that a
    query visits at most, for approximate answers."""
    near = nearest(queries, reference, k, others, probes)
    use = F.lit(True) if max_distance is None else F.col("distance") <= max_distance
    votes = near.groupBy("query_id", "label").agg(F.count_if(use).alias("n"), F.min("distance").alias("d"))
    best = votes.groupBy("query_id").agg(F.min("d").alias("closest_distance"), F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), "d", "label")).alias("b"))
    some = F.col("b.n") > 0
    out = best.select(F.col("query_id").alias("sequence_id"), F.when(some, F.col("b.label")).otherwise(UNKNOWN).alias("predicted_label"), F.round(F.when(some, 100.0 * F.col("b.n") / k).otherwise(0.0), 2).alias("confidence"), F.lit("embedding_knn").alias("method"), F.round("closest_distance", 6).alias("closest_distance"))
    return with_ranks(out)
