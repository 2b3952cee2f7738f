"""Chat formatting from reply trees, in DataFrame operations only.

Messages form trees by parent_id. Root-to-leaf paths are enumerated by iterative self-joins with
pointer doubling: round k joins each message to its 2**k-th ancestor, and each leaf's known path nodes to
theirs, so a chain of n messages takes log2(n) rounds and the path table grows to the output only. Branches
are ranked by the sum of their messages' scores; each chosen path is written as one conversation.

Template: "### ROLE: TEXT</turn>\\n". Inside texts a backslash is written \\e, "</turn>" \\t and "### " \\h;
inside roles also ":" as \\c. So a split at "</turn>\\n" is always a turn's end and unescaping is exact.

Nulls: a null role, text or score counts as empty or 0; a message whose parent is absent is a root; a null
tree_id is a tree of its own. msg_id must be unique and not null within its tree (rows without are left
out); a cycle of parents has no root, so neither it nor what hangs below it gives a path. Ties of branches go to the smaller
leaf id. Empty tables give empty results. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize

OPEN, CLOSE = "### ", "</turn>"


def escape(c: Column, role: bool = False) -> Column:
    out = F.coalesce(c, F.lit(""))
    pairs = [("\\", "\\e"), (CLOSE, "\\t"), (OPEN, "\\h")] + ([(":", "\\c")] if role else [])
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape(c: Column) -> Column:
    """escape() undone; every backslash in c starts one of its codes, so the order only matters for \\e, last."""
    for a, b in [("\\c", ":"), ("\\h", OPEN), ("\\t", CLOSE), ("\\e", "\\")]:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def paths(messages: DataFrame) -> DataFrame:
    """tree_id, leaf_id, msg_id, up (0 at the leaf) of every root-to-leaf path of messages(tree_id, msg_id, parent_id)."""
    m = messages.filter("msg_id is not null").select("tree_id", "msg_id", "parent_id")
    ids = m.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("p"))
    same = F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("p"))
    up = materialize(m.join(ids, same).select("tree_id", "msg_id", F.col("p").alias("above")), "chat-up")
    deepest = m.groupBy("tree_id").count().agg(F.max("count")).first()[0] or 0
    # ups[k]: each message's ancestor 2**k above it, as long as any message has one
    ups, on = [], F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("above") == F.col("m"))
    while not up.isEmpty() and 2 ** len(ups) < deepest:
        ups.append(up)
        nxt = up.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), F.col("above").alias("above2"))
        up = materialize(up.join(nxt, on).select("tree_id", "msg_id", F.col("above2").alias("above")), "chat-up")
    below = F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("p"))
    parents = m.filter("parent_id is not null").select(F.col("tree_id").alias("t"), F.col("parent_id").alias("p")).distinct()
    found = m.select("tree_id", "msg_id").join(parents, below, "left_anti")
    # an ancestor that is as far away as the tree has messages lies on a cycle
    endless = up.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("p"))
    found = found.join(endless, below, "left_anti").select("tree_id", F.col("msg_id").alias("leaf_id"), "msg_id", F.lit(0).alias("up"))
    for k, above in enumerate(ups):
        found = materialize(found, "chat-path")
        jump = above.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("p"), "above")
        more = found.join(jump, below).select("tree_id", "leaf_id", F.col("above").alias("msg_id"), (F.col("up") + 2**k).alias("up"))
        found = found.unionByName(more)
    return materialize(found, "chat-path")


def choose(path: DataFrame, messages: DataFrame, branches: int | None) -> DataFrame:
    """The path rows with role, text and pos (0 at the root), of the best `branches` leaves of each tree (None: all)."""
    body = messages.select(F.col("tree_id").alias("t"), F.col("msg_id").alias("m"), "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    on = F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("msg_id") == F.col("m"))
    rows = path.join(body, on).drop("t", "m")
    if branches is not None:
        total = rows.groupBy("tree_id", "leaf_id").agg(F.sum("score").alias("branch_score"))
        rank = F.row_number().over(W.partitionBy("tree_id").orderBy(F.col("branch_score").desc(), "leaf_id"))
        best = total.withColumn("r", rank).filter(F.col("r") <= branches).select(F.col("tree_id").alias("t"), F.col("leaf_id").alias("l"))
        rows = rows.join(best, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("leaf_id") == F.col("l"))).drop("t", "l")
    return rows


def render(rows: DataFrame) -> DataFrame:
    """One row a path: tree_id, leaf_id, formatted, loss_spans (start and length in code points of each assistant text)."""
    rows = rows.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role"), True), F.lit(": "))).withColumn("body", escape(F.col("text")))
    turn = F.struct(
        (-F.col("up")).alias("pos"), F.col("head"), F.col("body"),
        F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"),
        F.lit(0).cast("long").alias("at"),
    )
    grouped = rows.groupBy("tree_id", "leaf_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n"))), "")
    length = lambda t: F.length(t["head"]) + F.length(t["body"]) + len(CLOSE) + 1
    zero = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "turns", zero,
        lambda a, t: F.struct(
            (a["at"] + length(t)).cast("int").alias("at"),
            F.when(
                t["loss"],
                F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(t["head"])).cast("int").alias("start"), F.length(t["body"]).cast("int").alias("length")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return grouped.select("tree_id", "leaf_id", text.alias("formatted"), spans.alias("loss_spans"))


def format_trees(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """messages(tree_id, msg_id, parent_id, role, text, score) as conversations, one a chosen path."""
    m = messages.select("tree_id", "msg_id", "parent_id", "role", "text", "score")
    return render(choose(paths(m), m, branches))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE + "\n"), lambda x: x != "")
    mark = lambda x: F.instr(x, ": ")

    def turn(x: Column) -> Column:
        role = F.substring(x, F.lit(len(OPEN) + 1), mark(x) - 1 - len(OPEN))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, mark(x) + 2, F.length(x))).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
