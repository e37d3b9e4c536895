r"""Chat formatting over reply trees.

Messages are nodes with a parent. Paths from each leaf to its root come from repeated self-joins
that double their reach: ``hops`` maps a node to its ancestor 2^k steps up, and every (leaf,
ancestor) pair found so far is joined with it to give the pairs 2^k steps further. A tree of depth
d needs log2(d) rounds, no pair is made twice, and no array grows on the way. The branches of
a conversation are ranked by score; each chosen path is written as one text.

The template is ``<turn:role>text</turn>`` and a line end per turn. Inside roles and texts the
template's own characters are escaped, ``\`` as ``\b``, ``<`` as ``\l`` and ``>`` as ``\g``, so
that no text can open or close a turn, and reading back gives the exact text. Loss spans
(first character, length) cover the assistant texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept, scratch, table, written

#: Rounds of doubling; 2^40 turns in one path are more than any table has.
MAX_ROUNDS = 40


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(c, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    """Every ``\\`` of an escaped text begins one of three pairs, so the order of these is safe."""
    c = F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(c, F.lit("\\b"), F.lit("\\"))


def paths(tree: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): each leaf with every node on its way to the root, itself
    included at ``up`` 0. A node whose parent is null or missing is a root. Nodes on a cycle,
    and leaves below one, have no root and are left out.

    ``tree``: conv_id, node, parent, with distinct (conv_id, node).
    """
    with scratch():
        nodes = tree.select("conv_id", "node")
        known = tree.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
        at = lambda node: F.col("conv_id").eqNullSafe(F.col("c")) & (F.col(node) == F.col("n"))
        edges = written(tree.select("conv_id", "node", "parent").where(F.col("parent").isNotNull()).join(known, at("parent"), "left_semi"), "hops")
        inner = edges.select(F.col("conv_id").alias("c"), F.col("parent").alias("n")).distinct()
        leaves = nodes.join(inner, at("node"), "left_anti")
        found = written(leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
        most, hops, reach = nodes.count(), edges.select("conv_id", "node", F.col("parent").alias("to")), 1
        for _ in range(MAX_ROUNDS):
            if hops.isEmpty() or reach > most:
                break
            h = hops.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "to")
            more = found.join(h, at("node")).select("conv_id", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up"))
            found = written(found.unionByName(more), "paths")
            g = hops.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), F.col("to").alias("beyond"))
            hops = written(hops.join(g, at("to")).select("conv_id", "node", F.col("beyond").alias("to")), "hops")
            reach *= 2
        if reach > most:  # only a cycle goes on so long; a path that ends has a node without an edge
            e = edges.select(F.col("conv_id").alias("c"), F.col("node").alias("n"))
            ends = found.join(e, at("node"), "left_anti").select(F.col("conv_id").alias("c"), F.col("leaf").alias("l")).distinct()
            found = found.join(ends, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("leaf") == F.col("l")), "left_semi")
        return kept(found, "paths")


def format_trees(messages: DataFrame, best: int | None = None) -> DataFrame:
    """conv_id, leaf, branch_rank, score, n_turns, formatted, loss_spans of every chosen path.

    ``messages``: conv_id, node, parent, role, text and perhaps score (of a message; null or no
    column: 0). A path's score is the mean over its messages; the highest has rank 1, equal ones
    are ranked by leaf. ``best``: how many paths of a conversation stay, None for all.

    Null roles and texts are empty; texts of any length are taken whole. No row is dropped: rows with
    the same (conv_id, node) are messages of their own, replies go to the first of them by (parent,
    role, text, score), and the others are leaves; so is every row with a null node, as nothing can
    reply to it. A null conv_id is a conversation like another. Rows on a cycle, and below one, have
    no root and no path. Columns beyond those named are ignored.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in messages.columns else F.lit(0.0)
    rows = messages.select("conv_id", "node", "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), score.alias("score"))
    copy = F.row_number().over(W.partitionBy("conv_id", "node").orderBy("parent", "role", "text", "score"))
    own = F.struct(F.col("node").alias("id"), F.col("copy").alias("copy"))
    above = F.when(F.col("parent").isNotNull(), F.struct(F.col("parent").alias("id"), F.lit(1).alias("copy")))
    rows = rows.withColumn("copy", copy).select("conv_id", own.alias("node"), above.alias("parent"), "role", "text", "score")
    reach = paths(rows.select("conv_id", "node", "parent"))
    r = rows.select(F.col("conv_id").alias("c"), F.col("node").alias("n"), "role", "text", "score")
    turns = reach.join(r, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("node") == F.col("n")))
    role, text = escape(F.col("role")), escape(F.col("text"))
    piece = F.struct((-F.col("up")).alias("at"), F.concat(F.lit("<turn:"), role, F.lit(">")).alias("head"), text.alias("body"), (F.col("role") == "assistant").alias("loss"))
    one = turns.groupBy("conv_id", "leaf").agg(F.avg("score").alias("score"), F.sort_array(F.collect_list(piece)).alias("t"))
    one = one.select("conv_id", F.col("leaf.id").alias("leaf"), F.col("leaf.copy").alias("copy"), "score", "t")
    if best is not None or "score" in messages.columns:
        one = one.withColumn("branch_rank", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("score"), "leaf", "copy")))
        one = one if best is None else one.where(F.col("branch_rank") <= best)
    else:
        one = one.withColumn("branch_rank", F.row_number().over(W.partitionBy("conv_id").orderBy("leaf", "copy")))
    tail = "</turn>\n"
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(tail)
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    step = lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"))
    return one.select("conv_id", "leaf", "branch_rank", "score", F.size("t").cast("long").alias("n_turns"), formatted.alias("formatted"), F.aggregate("t", start, step, lambda a: a["spans"]).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the loss text, from nothing but the formatted text and the spans."""
    turn = F.split("formatted", "</turn>\n")
    cut = lambda x: F.struct(unescape(F.substring_index(F.substring(x, 7, 1 << 30), ">", 1)).alias("role"), unescape(F.substring_index(x, ">", -1)).alias("text"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.col("formatted").substr(s["start"] + 1, s["length"]))), "")
    return formatted.withColumns({"turns": F.transform(F.slice(turn, 1, F.size(turn) - 1), cut), "loss_text": loss})


def as_tree(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each row replies to the one before.
    Rows are ordered by turn (null ones last), role and text, nulls as empty; rows with equal turns,
    and equal rows, stay apart. ``node`` is a row's place from 1."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text"))
    rows = rows.withColumn("node", place)
    return rows.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_trees(as_tree(rows)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (SELECT *, 2 * len(role || text) - len(replace(replace(replace(role || text, '\', ''), '<', ''), '>', '')) AS n FROM rows),
one AS (
  SELECT conv_id, count(*) AS n_turns,
    coalesce(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text), '') AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '') AS loss,
    CAST(sum(len('<turn:') + 1 + n + len('</turn>') + 1) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(len(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM one
"""
