"""Chat formatting of reply trees.

Messages form trees. Self-joins that double the distance each time list, for
every leaf, the messages from it up to its root; branches are ranked by the sum
of their messages' scores, and each chosen branch becomes one conversation.

A turn is ``### role:`` and a line break, the text, a line break, ``</turn>``
and a line break. In texts a backslash goes before each backslash, ``#`` and
``<``, so no marker can occur inside one; in roles ``%`` and line breaks are
percent-encoded. The loss mask is a list of (start, end) in code points of the
formatted conversation, one for each assistant text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stage

END = "\n</turn>\n"
HEAD = "### "
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, "[\\\\#<]", "\\\\$0")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chain(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations (conv_id, turn, role, text) as trees: each replies to the one before it by turn.

    Rows with one turn number go by role, then text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long") - 1)
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 0, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def branches(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, score) for every root-to-leaf path of ``messages`` (tree, node, parent, score).

    Nodes are distinct longs in a tree. A parent that is null, isn't in the
    tree or isn't smaller than its node makes the node a root, so there are no
    cycles. After k joins every leaf has its 2^k nearest messages.
    """
    nodes = stage(messages.select("tree", "node", F.when(F.col("parent") < F.col("node"), F.col("parent")).alias("parent"), F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    known = nodes.select(F.col("tree").alias("k_tree"), F.col("node").alias("up"))
    ups = nodes.join(known, F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("parent") == F.col("up"))).select("tree", "node", "up")
    ups = stage(ups, "ups")
    leaves = nodes.join(ups.select(F.col("tree").alias("k_tree"), F.col("up").alias("k_up")), F.col("tree").eqNullSafe(F.col("k_tree")) & (F.col("node") == F.col("k_up")), "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node")
    while not ups.isEmpty():
        step = ups.select(F.col("tree").alias("s_tree"), F.col("node").alias("s_node"), F.col("up").alias("s_up"))
        same = lambda c: F.col("tree").eqNullSafe(F.col("s_tree")) & (F.col(c) == F.col("s_node"))
        paths = stage(paths.unionByName(paths.join(step, same("node")).select("tree", "leaf", F.col("s_up").alias("node"))), "paths")
        ups = stage(ups.join(step, same("up")).select("tree", "node", F.col("s_up").alias("up")), "ups")
    scored = nodes.select(F.col("tree").alias("n_tree"), F.col("node").alias("n_node"), "score")
    return paths.join(scored, F.col("tree").eqNullSafe(F.col("n_tree")) & (F.col("node") == F.col("n_node"))).select("tree", "leaf", "node", "score")


def chosen(paths: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, node) of the ``top`` branches of each tree by summed score, ties to the smaller leaf."""
    totals = paths.groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))
    best = stage(totals.withColumn("rank", rank).where(F.col("rank") <= top).select(F.col("tree").alias("b_tree"), F.col("leaf").alias("b_leaf"), "rank"), "best")
    return paths.join(best, F.col("tree").eqNullSafe(F.col("b_tree")) & (F.col("leaf") == F.col("b_leaf"))).select("tree", "leaf", "node", "rank")


def formatted(messages: DataFrame, top: int = 1) -> DataFrame:
    """(tree, leaf, rank, conversation, loss) for the ``top`` branches of each tree of ``messages`` (tree, node, parent, score, role, text).

    Null roles and texts: empty. A null tree is a tree like any other. Null
    scores: 0. Messages that repeat a node of their tree all stay, in the order
    of role and text. Other columns are ignored. No messages give no rows.
    """
    picked = chosen(branches(messages), top)
    body = messages.select(F.col("tree").alias("m_tree"), F.col("node").alias("m_node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = picked.distinct().join(body, F.col("tree").eqNullSafe(F.col("m_tree")) & (F.col("node") == F.col("m_node")))
    head = F.concat(F.lit(HEAD), _role_out(F.col("role")), F.lit(":\n"))
    turn = F.struct("node", "role", "text", head.alias("head"), escaped(F.col("text")).alias("body"))
    turns = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    empty = F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>))")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["head"])
        end = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(t["role"] == LOSS_ROLE, F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    loss = F.aggregate("turns", empty, step, lambda acc: acc["spans"])
    return turns.select("tree", "leaf", "rank", whole.alias("conversation"), loss.alias("loss"))


def digests(conversations: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    pieces = F.split("conversation", END)
    turns = F.transform(
        F.slice(pieces, 1, F.size(pieces) - 1),
        lambda t: F.concat(_role_of(t), F.lit("\n"), _text_of(t), F.lit("\n")),
    )
    masked = F.transform("loss", lambda s: unescaped(F.substring("conversation", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    loss = F.array_join(masked, "")
    return conversations.select(
        "tree", "leaf", "rank", (F.size(pieces) - 1).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("conversation").cast("long").alias("formatted_chars"),
    )


def _role_of(turn: Column) -> Column:
    line = F.substring_index(turn, "\n", 1)
    return _role_in(line.substr(F.lit(len(HEAD) + 1), F.length(line) - len(HEAD) - 1))


def _text_of(turn: Column) -> Column:
    line = F.length(F.substring_index(turn, "\n", 1))
    return unescaped(turn.substr(line + 2, F.length(turn)))
