"""Conversations from reply trees: root-to-leaf paths, ranked by score, formatted with a loss mask."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import cut

#: Levels up to which paths are listed before nodes on or below a cycle are looked for.
SHALLOW = 64

#: The template's marks, and the control strings that texts may not hold as they are.
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = r"(<)(?=\||/?s>|</?SYS>>)|(\[)(?=/?INST\])"

_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(\\|n?)")


def escape(text: Column) -> Column:
    """Text in which no control string is left: a backslash goes into each, and backslashes double."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1$2\\")


def escape_role(role: Column) -> Column:
    """As escape(), for a role, which ends at its line's end."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", "n": "\n", "": ""}[m[1]], text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs that a formatted conversation was made from."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def paths(nodes: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", score: str = "score", top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, depth, node) for every node of each chosen root-to-leaf path, depth 0 at the root.

    Self-joins find the ancestors of every leaf: each round joins paths with jumps twice as long,
    so n levels take log2 n rounds. A path scores the mean of its nodes' scores (null: 0); a tree's
    paths rank by score, ties by leaf, and the ``top`` best are chosen (None: all). Nodes whose
    parent is null or missing are roots. Rows that repeat a (tree, node) count once; nodes on
    or below a cycle have no root and are left out: where trees are deeper than SHALLOW, pointers double until
    they pass as many levels as the largest tree has nodes, and who still has an ancestor then goes. Rows
    with a null node are passed over, an empty table gives no rows, and other columns don't matter.
    """
    rows = nodes.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), F.coalesce(F.col(score).cast("double"), F.lit(0.0)).alias("score")).where("node IS NOT NULL")
    rows = cut(rows.groupBy("tree", "node").agg(F.min_by("parent", F.struct("parent")).alias("parent"), F.max("score").alias("score")))
    known = rows.select("tree", F.col("node").alias("parent")).distinct()
    jump = cut(rows.alias("r").join(known.alias("k"), F.col("r.tree").eqNullSafe(F.col("k.tree")) & (F.col("r.parent") == F.col("k.parent"))).select("r.tree", "r.node", F.col("r.parent").alias("up")))
    parents = jump.select("tree", F.col("up").alias("node")).distinct()
    leaves = rows.alias("r").join(parents.alias("p"), F.col("r.tree").eqNullSafe(F.col("p.tree")) & (F.col("r.node") == F.col("p.node")), "left_anti")
    found = cut(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("bigint").alias("up_by")))
    length, rooted = 1, False
    while not jump.isEmpty():
        if length >= SHALLOW and not rooted:
            jump, found, rooted = *_rooted(rows, jump, found, length), True
            continue
        further = found.alias("f").join(jump.alias("j"), F.col("f.tree").eqNullSafe(F.col("j.tree")) & (F.col("f.node") == F.col("j.node"))).select("f.tree", "f.leaf", F.col("j.up").alias("node"), (F.col("f.up_by") + length).alias("up_by"))
        # found holds the ancestors up to length - 1 above each leaf; these are the next length ones.
        found = cut(found.unionByName(further))
        jump = cut(_doubled(jump))
        length *= 2
    scored = found.alias("f").join(rows.alias("r"), F.col("f.tree").eqNullSafe(F.col("r.tree")) & (F.col("f.node") == F.col("r.node"))).select("f.*", "r.score")
    whole = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("path_score"), F.max("up_by").alias("length"))
    rank = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
    chosen = whole.withColumn("rank", F.row_number().over(rank))
    if top is not None:
        chosen = chosen.where(F.col("rank") <= top)
    return found.alias("f").join(chosen.alias("c"), F.col("f.tree").eqNullSafe(F.col("c.tree")) & (F.col("f.leaf") == F.col("c.leaf"))).select("f.tree", "f.leaf", "c.rank", (F.col("c.length") - F.col("f.up_by")).cast("int").alias("depth"), "f.node")


def _doubled(jump: DataFrame) -> DataFrame:
    """Jumps (tree, node, up) of twice the length."""
    return jump.alias("a").join(jump.alias("b"), F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.up") == F.col("b.node"))).select("a.tree", "a.node", "b.up")


def _rooted(rows: DataFrame, jump: DataFrame, found: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """jump and found without the nodes on or below a cycle: those that have an ancestor as far up as the tree has nodes."""
    largest = rows.groupBy("tree").count().agg(F.max("count")).first()[0]
    far = jump
    while length < largest and not far.isEmpty():
        far, length = cut(_doubled(far)), length * 2
    if far.isEmpty():
        return jump, found
    lost = far.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    jump = cut(jump.join(lost, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti"))
    return jump, cut(found.join(lost, F.col("tree").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("n")), "left_anti"))


def render(turns: DataFrame, keys: list[str], order: str = "depth", role: str = "role", text: str = "text") -> DataFrame:
    """keys, formatted, and loss: the spans (start, end: code points) of the escaped assistant texts.

    A turn is ``<|im_start|>role`` and a line end, the text, ``<|im_end|>`` and a line end. Null roles and texts are
    empty. Only what assistants say is under the loss mask, without marks.
    """
    said = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), escape_role(F.coalesce(role, F.lit(""))).alias("role"), escape(F.coalesce(text, F.lit(""))).alias("text"))))
    rows = turns.groupBy(*keys).agg(said.alias("__turns"))
    head, tail = len(START) + 1, len(END)
    rows = rows.withColumn("formatted", F.concat_ws("", F.transform("__turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END)))))
    size = lambda t: F.length(t["role"]) + F.length(t["text"]) + head + tail
    # One pass with the running length; each turn adds its span.
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    start = lambda s, t: s["at"] + F.length(t["role"]) + head
    folded = F.aggregate("__turns", state, lambda s, t: F.struct((s["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], F.array(F.struct(start(s, t).alias("start"), (start(s, t) + F.length(t["text"])).alias("end"))))).otherwise(s["spans"]).alias("spans")))
    return rows.select(*keys, "formatted", folded["spans"].alias("loss"))


def conversations(rows: DataFrame, tree: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", score: Column | None = None, parent: Column | None = None, top: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss) for each chosen path of each reply tree.

    Without ``parent`` (the number of the row replied to), each row replies to the one before in
    order of turn; rows that share a turn follow each other in order of role and text, nulls first.
    All rows count, repeated ones too. A conversation that is one formatted string is put together
    in one task; anything before that is spread by tree and row. Null roles and texts are empty, null
    trees are one tree, an empty table gives no rows, and other columns don't matter, whatever their names.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    named = rows.select(F.col(tree).alias("tree"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), (score if score is not None else F.lit(0.0)).cast("double").alias("score"), (parent if parent is not None else F.lit(None)).cast("bigint").alias("parent"))
    if parent is None:
        named = named.withColumn("node", F.row_number().over(order).cast("bigint")).withColumn("parent", F.col("node") - 1)
    else:
        named = named.withColumn("node", F.col("turn").cast("bigint"))
    named = cut(named)
    chosen = paths(named, top=top)
    joined = chosen.alias("c").join(named.alias("n"), F.col("c.tree").eqNullSafe(F.col("n.tree")) & (F.col("c.node") == F.col("n.node"))).select("c.tree", "c.leaf", "c.rank", "c.depth", "n.role", "n.text")
    return render(joined, ["tree", "leaf", "rank"])
