"""Reply trees to formatted conversations, in DataFrame functions only.

``paths`` enumerates all root-to-leaf paths by iterative self-joins: with
``jump`` (each message's ancestor 2**k steps up) a set of known ancestors
doubles its reach in each round, so a tree of depth d takes log2(d) joins and no
more rows than the paths have.  Texts may be of any length.  ``ranked`` orders the branches of a tree by the
mean score of their messages.  ``formatted`` writes each chosen path as one
conversation.

Template: an assistant turn is ``<s>role[|]text</s>``, any other turn is
``[INST]role[|]text[/INST]``.  Within roles and texts a backslash is doubled,
and a backslash goes behind the first character of each control string
(``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, ``[|]``); ``unescaped`` undoes
both.  The loss mask has the intervals of the assistant texts, in code points.

Null texts and roles count as empty.  A message whose parent is null or unknown
is a root; rows of one id are one message (ties go to the smallest role, then
text).  Messages on a cycle and replies below one have no root and are left out.  Null scores count
as 0; equal branches are ranked by leaf id.  Other columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm import cluster

#: Control strings of the template, as a pattern behind their first character.
_CONTROL = r"(<)(?=/?s>)|(\[)(?=/?INST\]|\|\])"


def escaped(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def paths(messages: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``tree``, ``leaf``, ``up`` (steps above the leaf), ``msg``.

    ``messages`` has ``tree``, ``msg``, ``parent``.
    """
    nodes = messages.select("tree", "msg", "parent").groupBy("tree", "msg").agg(F.min("parent").alias("parent"))
    names = nodes.select("tree", F.col("msg").alias("parent"))
    links = cluster.written(nodes.join(names, ["tree", "parent"], "left_semi").select("tree", "msg", "parent"), "links")
    nodes = cluster.written(nodes.select("tree", "msg"), "nodes")
    leaves = nodes.join(links.select("tree", F.col("parent").alias("msg")), ["tree", "msg"], "left_anti")
    known = leaves.select("tree", F.col("msg").alias("leaf"), F.lit(0).cast("long").alias("up"), "msg")
    jump = links.select("tree", "msg", F.col("parent").alias("above"))
    step = 1
    for _ in range(max_rounds):
        if jump.isEmpty():
            return known
        more = known.join(jump, ["tree", "msg"]).select("tree", "leaf", (F.col("up") + step).alias("up"), F.col("above").alias("msg"))
        known = cluster.written(known.unionByName(more), "paths")
        second = jump.select("tree", F.col("msg").alias("above"), F.col("above").alias("far"))
        jump = cluster.written(jump.join(second, ["tree", "above"]).select("tree", "msg", F.col("far").alias("above")), "jump")
        step *= 2
        if step > 2 and more.isEmpty():
            return known
        if step >= 64 and step >= (nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0):
            # Who still has an ancestor so far up has a cycle above.
            return known.join(jump.select("tree", F.col("msg").alias("leaf")), ["tree", "leaf"], "left_anti")
    raise RuntimeError("paths are too deep")


def ranked(messages: DataFrame, best: int | None = None) -> DataFrame:
    """``tree``, ``leaf``, ``branch`` (1 is best), ``turns``: an array of
    (role, text) from the root to the leaf.  ``best`` keeps so many a tree."""
    plain = messages.groupBy("tree", "msg").agg(
        F.min("parent").alias("parent"), F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("said"), F.coalesce(F.max("score"), F.lit(0.0)).alias("score")
    )
    plain = cluster.written(plain, "messages")
    joined = paths(plain).join(plain.select("tree", "msg", "said", "score"), ["tree", "msg"])
    turns = joined.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), F.col("said")))).alias("turns"), F.avg("score").alias("score"))
    order = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
    out = turns.withColumn("branch", F.row_number().over(order))
    out = out.where(F.col("branch") <= best) if best is not None else out
    return out.select("tree", "leaf", "branch", F.transform("turns", lambda t: t["said"]).alias("turns"))


def formatted(conversations: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds ``formatted`` and ``loss`` (intervals from and up to, in code points)."""
    is_assistant = lambda t: t["role"] == "assistant"
    piece = lambda t: F.when(is_assistant(t), F.concat(F.lit("<s>"), escaped(t["role"]), F.lit("[|]"), escaped(t["text"]), F.lit("</s>"))).otherwise(
        F.concat(F.lit("[INST]"), escaped(t["role"]), F.lit("[|]"), escaped(t["text"]), F.lit("[/INST]"))
    )
    pieces = conversations.withColumn("_pieces", F.transform(turns, lambda t: F.struct(is_assistant(t).alias("loss"), piece(t).alias("piece"))))
    pieces = pieces.withColumn("_sizes", F.transform("_pieces", lambda p: F.char_length(p["piece"]).cast("long")))
    starts = F.aggregate("_sizes", F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    pieces = pieces.withColumn("_starts", starts)
    spans = F.transform("_pieces", lambda p, i: F.struct(p["loss"].alias("loss"), (F.element_at("_starts", i + 1) + F.length(F.lit("<s>assistant[|]"))).alias("from"), (F.element_at("_starts", i + 2) - F.length(F.lit("</s>"))).alias("to")))
    return (
        pieces.withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: p["piece"]), ""))
        .withColumn("loss", F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"))))
        .drop("_pieces", "_sizes", "_starts")
    )


def parsed(text: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)(?:<s>|\[INST\])(.*?)(?:</s>|\[/INST\])"), F.lit(1))
    return F.transform(
        found,
        lambda t: F.struct(unescaped(F.substring_index(t, "[|]", 1)).alias("role"), unescaped(F.substr(t, F.instr(t, F.lit("[|]")) + F.lit(3))).alias("text")),
    )


def loss_text(text: Column, spans: Column) -> Column:
    """What a loss mask covers of a formatted conversation, unescaped."""
    return unescaped(F.array_join(F.transform(spans, lambda s: F.substr(text, (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int"))), ""))
