"""Conversations from reply trees, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meritlake.llm.base import written

#: The template's control strings.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(c: Column) -> Column:
    """Give every '<' + n backslashes + '|' one backslash more: no control string is left, and unescape() takes it away."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def unescape(c: Column) -> Column:
    """The inverse of escape()."""
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    """As escape(), and a role keeps to one line: backslash doubled, newline as backslash n."""
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    """The inverse of escape_role(): between doubled backslashes, backslash n is a newline."""
    between = F.split(F.replace(unescape(c), F.lit("\\\\"), F.lit("\n")), "\n", -1)
    return F.array_join(F.transform(between, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def as_tree(turns: DataFrame) -> DataFrame:
    """(conv_id, node, parent, role, text, score): each row of (conv_id, turn, role, text) answers the one before it.

    Rows are ordered by turn; ties by role, then text; a null turn comes first. Null role or text: empty.
    """
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = clean.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def ancestors(tree: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(jumps, ends) of the nodes of (conv_id, node, parent, score).

    jumps[r]: (conv_id, node, up, score, depth) of the nodes that have a 2**r-th ancestor, up; score and depth are the sum and number
    of the nodes before it. ends: (conv_id, node, score, depth) of all nodes up to their root. A table is the one
    before joined to itself, so a tree of depth d takes log2(d) rounds, and a node takes part in those that its own depth
    needs, with one row of numbers. A parent that is missing makes its child a root. A round after which no more nodes have
    reached a root is the last: what still goes on leads into a cycle of parents and has no root, so it is in no path.
    """
    nodes = tree.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select("conv_id", F.col("node").alias("parent"), F.lit(True).alias("there"))
    now = written(nodes.join(known, ["conv_id", "parent"], "left").select("conv_id", "node", F.when(F.col("there"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("depth")), "ancestors")
    jumps, ends = [], now.where("up is null")
    going = now.where("up is not null")
    while not going.isEmpty():
        jumps.append(going)
        above = ends.unionByName(going).select("conv_id", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        more = going.join(above, ["conv_id", "up"]).select("conv_id", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth"))
        now = written(more, "ancestors")
        if now.where("up is null").isEmpty():
            break
        ends, going = ends.unionByName(now.where("up is null")), now.where("up is not null")
    return jumps, ends.drop("up")


def _once(tree: DataFrame) -> DataFrame:
    """One whole row for each node, written, so that all that reads it has the same one; rows without conv_id or node are left out."""
    rows = tree.select("conv_id", "node", "parent", "role", "text", "score").where("conv_id is not null and node is not null")
    return written(rows.dropDuplicates(["conv_id", "node"]), "tree")


def best_paths(tree: DataFrame, best: int = 1) -> DataFrame:
    """(conv_id, branch, leaf, path_score, at, node): the best root-to-leaf paths of each tree, a row for each node, at from 1 at the root.

    Branches are ranked by score (the sum of their nodes' scores, null as 0), then depth, then leaf. Only the chosen leaves'
    paths are enumerated: a stretch of a path is halved at its ancestor until stretches are nodes. tree has a row for each node.
    """
    jumps, ends = ancestors(tree)
    inner = tree.where("parent is not null").select("conv_id", F.col("parent").alias("node")).distinct()
    leaves = ends.join(inner, ["conv_id", "node"], "left_anti")
    rank = Window.partitionBy("conv_id").orderBy(F.desc("score"), F.desc("depth"), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= best)
    stretch = chosen.select("conv_id", "branch", F.col("node").alias("leaf"), F.col("score").alias("path_score"), "node", F.col("depth").alias("at"), F.col("depth").alias("size"))
    whole = None
    for r in reversed(range(len(jumps))):
        half = 2**r
        named = lambda node, at, size: F.struct(node.alias("node"), at.alias("at"), size.alias("size"))
        node, at, size = F.col("node"), F.col("at"), F.col("size")
        stretch = written(stretch, "stretches")
        short, cut = stretch.where(size == 1), F.array(named(F.col("up"), at - half, size - half), named(node, at, F.lit(half).cast("long")))
        whole = short if whole is None else whole.unionByName(short)
        split = stretch.where(size > half).join(jumps[r].select("conv_id", "node", "up"), ["conv_id", "node"]).select("conv_id", "branch", "leaf", "path_score", F.explode(cut).alias("x"))
        stretch = split.select("conv_id", "branch", "leaf", "path_score", "x.node", "x.at", "x.size").unionByName(stretch.where((size > 1) & (size <= half)).select("conv_id", "branch", "leaf", "path_score", "node", "at", "size"))
    stretch = stretch if whole is None else whole.unionByName(stretch)
    return stretch.drop("size")


def format_paths(tree: DataFrame, best: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, branch, leaf, score, n_turns, formatted, loss_spans): the best paths of each tree as one text each.

    tree: (conv_id, node, parent, role, text, score); rows with a null conv_id or node belong to no tree and are left out,
    other columns are ignored, and of rows with one node one counts, whole. Nodes that lead into a cycle of parents are left out. A turn is OPEN role newline text CLOSE newline.
    loss_spans are the places (start from 0, length, in code points) of the loss_role's texts in formatted. An empty tree
    table gives no rows.
    """
    tree = _once(tree)
    steps = best_paths(tree, best)
    said = tree.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    turn = F.struct("at", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("loss"))
    turns = (
        steps.join(said, ["conv_id", "node"])
        .groupBy("conv_id", "branch", "leaf")
        .agg(F.first("path_score").alias("score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    )
    tail = len(CLOSE) + 1
    widths = F.transform("turns", lambda t: F.length(t.head) + F.length(t.body) + tail)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    walk = F.aggregate(
        F.arrays_zip(F.col("turns").alias("t"), widths.alias("w")),
        start,
        lambda s, x: F.struct(
            (s["at"] + x["w"]).alias("at"),
            F.when(
                x["t"]["loss"],
                F.concat(s["spans"], F.array(F.struct((s["at"] + F.length(x["t"]["head"])).alias("start"), F.length(x["t"]["body"]).alias("length")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(CLOSE + "\n"))), "")
    return turns.select("conv_id", "branch", "leaf", "score", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), walk.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """formatted with turns array<struct<role, text>> and loss_text, both parsed from the formatted text alone and its spans."""
    parts = F.filter(F.split(F.col("formatted"), r"<\|im_end\|>\n", -1), lambda p: p != "")
    body = lambda p: F.substring(p, len(OPEN) + 1, 2**31 - 1)
    turn = lambda p: F.struct(
        unescape_role(F.substring_index(body(p), "\n", 1)).alias("role"),
        unescape(F.substring(p, F.instr(p, F.lit("\n")) + 1, F.lit(2**31 - 1))).alias("text"),
    )
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(masked, ""))
