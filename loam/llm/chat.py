"""Chat formatting over reply trees.

Messages form trees by parent. Root-to-leaf paths are enumerated by iterative self-joins that double
the known stretch of ancestors each time: a message carries a pointer to the ancestor reached, never
a path, so a tree of depth d takes log2(d) joins over rows of fixed size. Branches are ranked within
a tree by the sum of their messages' scores (ties: by their leaf's node id). The messages of a chosen
branch are marked from its leaf upwards by the same pointers, longest jumps first; a root with a
single leaf needs no marking. Each chosen path is written as one conversation:

    ### role: text</turn>\\n

``\\``, ``#``, ``<`` in texts and also ``:`` in roles get a backslash before them, so no text can look
like a marker and reading back is exact. ``loss`` holds the spans of the assistant texts.

Defined results: null text or role is the empty string; a null conversation id is a conversation of
its own, told apart from every other id; messages of equal turn are ordered by role, then text, and
repeated rows stay; a message whose parent is missing starts a tree; replies in a circle are cut above
the circle's smallest node id, which starts a tree; a null score counts as 0; of messages that share a
node id the first by role and text is written, under the smallest parent; messages without a node id
are left out; an empty table gives none; further columns are ignored. A conversation is one row of
the result, so it has to fit into a task.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.plans.materialize import keep

END = "</turn>\n"
TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.S)


def linear_replies(rows: DataFrame) -> DataFrame:
    """Messages (tree, node, parent, role, text, score) of plain conversations: each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def _key(tree: Column) -> Column:
    """The tree's id as text; no id is like the missing one."""
    return F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-"))


def _climb(links: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """What is reached from the roots, from links (k, node, top: the parent or null, score).

    First: k, node, root, depth, score (summed from the root). Second: for every j the rows (k, node,
    top) in which top is the 2**j-th ancestor. Third: the messages on or below a circle, None if there
    is none. A round doubles all stretches, so one in which nothing arrives leaves only circles.
    """
    whole = links.where("top IS NULL").select("k", "node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), "score")
    rising, jumps = links.where("top IS NOT NULL"), []
    n = rising.count()
    while n:
        none = F.lit(None).cast("long")
        root = F.lit(None).cast(dict(whole.dtypes)["root"])
        above = whole.select("k", F.col("node").alias("top"), F.lit(None).cast(dict(rising.dtypes)["top"]).alias("up"), "root", "depth", F.col("score").alias("more"))
        above = above.unionAll(rising.select("k", F.col("node").alias("top"), F.col("top").alias("up"), root.alias("root"), none.alias("depth"), F.col("score").alias("more")))
        met = keep(
            rising.join(above, ["k", "top"]).select(
                "k", "node", F.col("up").alias("top"), "root", (F.col("depth") + (1 << len(jumps))).alias("depth"), (F.col("score") + F.col("more")).alias("score")
            ),
            "chat-climb",
        )
        jumps.append(rising.select("k", "node", "top"))
        whole = whole.unionAll(met.where("top IS NULL").select("k", "node", "root", "depth", "score"))
        rising = met.where("top IS NOT NULL").select("k", "node", "top", "score")
        left = rising.count()
        if left == n:
            return whole, jumps, rising.select("k", "node")
        n = left
    return whole, jumps, None


def _cut_circles(links: DataFrame) -> DataFrame:
    """``links`` of messages on or below circles, the smallest node of each circle made a root."""
    stretch, covered, n = links.select("k", "node", "top", F.col("node").alias("low")), 1, links.count()
    while covered < n:
        above = stretch.select("k", F.col("node").alias("top"), F.col("top").alias("up"), F.col("low").alias("more"))
        stretch = keep(stretch.join(above, ["k", "top"]).select("k", "node", F.col("up").alias("top"), F.least("low", "more").alias("low")), "chat-circles")
        covered *= 2
    # no stretch is shorter than a circle now: all tops lie on circles, and a message on one has seen all of it
    on = stretch.select("k", F.col("top").alias("node")).distinct()
    first = stretch.where("node = low").join(on, ["k", "node"], "left_semi").select("k", "node", F.lit(True).alias("first"))
    return links.join(first, ["k", "node"], "left").select("k", "node", F.when(F.col("first").isNull(), F.col("top")).alias("top"), "score")


def branches(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """k (the tree's key), branch, node, pos: the messages of the best ``per_tree`` branches of each tree, pos 0 the root."""
    m = messages.where("node IS NOT NULL").select(_key(F.col("tree")).alias("k"), "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    m = m.groupBy("k", "node").agg(F.min(F.struct("parent", "score")).alias("m")).select("k", "node", "m.parent", "m.score")
    alive = m.select("k", F.col("node").alias("parent"), F.lit(True).alias("known"))
    links = keep(m.join(alive, ["k", "parent"], "left").select("k", "node", F.when(F.col("known"), F.col("parent")).alias("top"), "score"), "chat-links")
    whole, jumps, circling = _climb(links)
    if circling is not None:
        freed = keep(_cut_circles(keep(links.join(circling, ["k", "node"], "left_semi"), "chat-circling")), "chat-freed")
        links = keep(links.join(circling, ["k", "node"], "left_anti").unionAll(freed), "chat-links")
        whole, jumps, _ = _climb(links)
    inner = links.where("top IS NOT NULL").select("k", F.col("top").alias("node")).distinct()
    leaves = keep(whole.join(inner, ["k", "node"], "left_anti"), "chat-leaves")
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.col("score").desc(), "node"))
    chosen = leaves.withColumn("branch", rank).where(F.col("branch") <= per_tree)
    ends = leaves.groupBy("k", "root").agg(F.count("*").alias("ends"))
    chosen = keep(chosen.join(ends, ["k", "root"]), "chat-chosen")
    straight = whole.join(chosen.where("ends = 1").select("k", "root", "branch"), ["k", "root"]).select("k", "branch", "node", F.col("depth").alias("pos"))
    marked = chosen.where("ends > 1").select("k", "branch", "node", F.col("depth").alias("pos"))
    if not marked.isEmpty():
        for j in reversed(range(len(jumps))):
            above = marked.join(jumps[j], ["k", "node"]).select("k", "branch", F.col("top").alias("node"), (F.col("pos") - (1 << j)).alias("pos"))
            marked = keep(marked.unionAll(above), "chat-marked")
    return straight.unionAll(marked)


def escape(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"([\\#<{also}])", r"\\$1")


def format_chats(messages: DataFrame, per_tree: int = 1, learn: str = "assistant") -> DataFrame:
    """tree, branch, formatted, loss (spans of the ``learn`` role's texts in ``formatted``)."""
    paths = branches(messages, per_tree)
    said = messages.select("tree", _key(F.col("tree")).alias("k"), "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, ["k", "node"])
    head = F.concat(F.lit("### "), escape(F.col("role"), ":"), F.lit(": "))
    body = escape(F.col("text"))
    turns = turns.select("tree", "k", "branch", F.struct("pos", head.alias("head"), body.alias("body"), (F.col("role") == learn).alias("learn")).alias("t"))
    whole = turns.groupBy("k", "branch").agg(F.first("tree").alias("tree"), F.array_sort(F.collect_list("t")).alias("turns"))
    # of messages that share a node id the first one is written
    whole = whole.withColumn("turns", F.filter("turns", lambda t, i: (i == 0) | (t["pos"] != F.get(F.col("turns"), F.greatest(i - 1, F.lit(0)))["pos"])))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + F.length(t["head"])
        stop = start + F.length(t["body"])
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct((stop + len(END)).alias("at"), F.when(t["learn"], F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return whole.select("tree", "branch", text.alias("formatted"), F.aggregate("turns", begin, step)["out"].alias("loss"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digest(formatted: str, loss: str) -> Column:
    """What a reader of the output columns finds in them."""
    kind = "struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string,formatted_chars:long>"
    return F.pandas_udf(_digest, kind)(formatted, loss)


def _digest(formatted: pd.Series, loss: pd.Series) -> pd.DataFrame:
    out = []
    for text, spans in zip(formatted, loss, strict=True):
        turns = read_back(text)
        learned = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
    return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
