"""Chat formatting of reply trees, with DataFrame functions only.

A conversation is a tree of messages. Self-joins over jump pointers (each round doubles the distance to the ancestor)
enumerate every root-to-leaf path in log2(depth) rounds, so that neither rounds nor rows grow with depth times depth.
Branches are ranked by the sum of their messages' scores, and each chosen path is formatted as one conversation.

Template of a turn: ``<s>`` role, newline, text, ``</s>``. Inside roles and texts ``&``, ``<`` and ``[`` (and a role's
newlines) are written as entities, so that no control string of this or of other templates can occur in content, and
the escape is undone exactly on reading back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

OPEN, CLOSE = "<s>", "</s>"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&#10;"))


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&#91;"), F.lit("["))
    return F.replace(F.replace(out, F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def _null_safe(*columns: str) -> Column:
    """A join key in which null equals null."""
    return F.struct(*[x for i, c in enumerate(columns) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])


def thread_nodes(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees: each message replies to the one before it.

    Ties of ``turn`` are ordered by role and text; null turns come first. Repeated rows are repeated messages.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node_id"))
    return numbered.select("conv_id", "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """Messages of the ``branches`` best root-to-leaf paths of each tree.

    nodes: conv_id, node_id (unique in a conversation), parent_id (null at a root), role, text, score (null counts 0);
    other columns are ignored. Returns conv_id, branch (1 = best), branch_score, position (0 = root), role, text.
    Branches are ranked by score, ties by smaller leaf node_id. A message whose parent is missing begins a path of its
    own; messages of a parent cycle belong to no path. An empty table gives no rows. Scores run along jump pointers, a
    row for each message however many leaves there are; only the chosen paths are enumerated.
    """
    links = checkpointed(nodes.select(_null_safe("conv_id").alias("conv"), "conv_id", "node_id", "parent_id", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score")))
    known = links.select("conv", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    # each node with an ancestor ``up``, the score of the stretch below it, and the stretch's length
    step = links.select("conv", "node_id", "parent_id", "score").join(known, ["conv", "parent_id"], "left")
    step = checkpointed(step.select("conv", "node_id", F.when(F.col("known"), F.col("parent_id")).alias("up"), "score", F.lit(1).cast("long").alias("length")))
    parents = step.where("up is not null").select("conv", F.col("up").alias("node_id")).distinct()
    deepest = links.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    jumps, reach = [], 1
    while reach < deepest:
        jumps.append((reach, step.where("up is not null").select("conv", "node_id", "up")))
        ahead = step.select("conv", F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("score").alias("more"), F.col("length").alias("further"))
        # messages that have reached their root are not joined again
        joined = step.where("up is not null").join(ahead, ["conv", "up"])
        joined = joined.select("conv", "node_id", F.col("up2").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("length") + F.col("further")).alias("length"))
        step = checkpointed(step.where("up is null").unionByName(joined))
        reach *= 2
    # leaves whose pointer ran out reach a root; of these the best are chosen, and only their paths are made
    leaves = step.where("up is null").join(parents, ["conv", "node_id"], "left_anti")
    best = Window.partitionBy("conv").orderBy(F.desc("score"), "node_id")
    chosen = leaves.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    members = chosen.select("conv", "node_id", "branch", F.col("score").alias("branch_score"), (F.col("length") - 1).alias("position"))
    for reach, jump in jumps:
        further = members.join(jump, ["conv", "node_id"]).select("conv", F.col("up").alias("node_id"), "branch", "branch_score", (F.col("position") - reach).alias("position"))
        members = checkpointed(members.unionByName(further))
    return members.join(links.drop("score"), ["conv", "node_id"]).select("conv_id", "branch", "branch_score", "position", "role", "text")


def format_paths(messages: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """One formatted conversation per (conv_id, branch).

    Returns conv_id, branch, branch_score, n_turns, formatted, and loss_spans: start (0-based) and length in code
    points of each stretch of ``formatted`` that carries loss, the texts of ``learned_role``. Null role or text: empty.
    """
    head = F.concat(F.lit(OPEN), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    body = escaped(F.coalesce("text", F.lit("")))
    turns = messages.select("conv_id", "branch", "branch_score", "position", F.coalesce(F.col("role") == learned_role, F.lit(False)).alias("learned"), head.alias("head"), body.alias("body"))
    turns = turns.withColumn("chars", F.length("head") + F.length("body") + len(CLOSE))
    before = Window.partitionBy("conv_id", "branch").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)) + F.length("head"))
    turn = F.struct("position", "learned", "start", F.length("body").cast("long").alias("length"), F.concat("head", "body", F.lit(CLOSE)).alias("turn"))
    whole = turns.groupBy("conv_id", "branch").agg(F.first("branch_score").alias("branch_score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.select("conv_id", "branch", "branch_score", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    parts = F.filter(F.split(formatted, OPEN), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        start = F.length(role) + 2
        return F.struct(unescaped(role).alias("role"), unescaped(p.substr(start, F.length(p) - len(CLOSE) - start + 1)).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescaped(formatted.substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``format_paths`` of linear conversations: one row per conv_id."""
    return format_paths(reply_paths(thread_nodes(turns)))
