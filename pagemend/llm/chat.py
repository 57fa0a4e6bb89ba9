"""Chat formatting of reply trees, with DataFrame functions only.

A forest has rows (tree, node, parent, score, role, text); ``parent`` is null for roots.
Root-to-leaf paths are enumerated by iterative self-joins that double their reach: at
step k every (leaf, node) pair joins the table of 2**k-th ancestors, which is then
joined with itself. A chain of n turns takes log2(n) joins and n rows, not n joins.
Branches of a tree are ranked by score (sum over the path, ties to the smaller leaf).

Template of a turn: ``### role:`` newline, the text, newline ``</turn>`` newline. The
role is URL-encoded. In texts a backslash goes before each backslash, ``<`` and ``#``,
so markers of the template can't occur inside; taking one backslash away from each such
pair restores the text. Texts are joined in two levels (blocks of turns, then blocks),
and the loss mask lists the [start, end) code points of assistant texts.

Defined cases: null text and null role count as empty; null ids of trees form one tree
with a null id; equal turns are ordered by role, then text; an empty table gives no rows.
In a forest, rows with a null node take no part; of rows that repeat a (tree, node) the one
with the least (parent, score, role, text) stays, nulls first; a parent that isn't a node of
the tree counts as null, so its children are roots; nodes on a cycle of parents, and all
below them, have no root and are on no path. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

END = "\n</turn>\n"
BLOCK = 256


def escape(col):
    return F.regexp_replace(col, r"([\\<#])", r"\\$1")


def unescape(col):
    return F.regexp_replace(col, r"\\([\\<#])", "$1")


def format_turn(role, text):
    return F.concat(F.lit("### "), F.url_encode(role), F.lit(":\n"), escape(text), F.lit(END))


def header_length(role):
    return F.length(F.url_encode(role)) + F.lit(len("### ") + len(":\n"))


def chain_nodes(conversations: DataFrame) -> DataFrame:
    """Conversations as trees of one branch: a turn replies to the turn before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select(
        F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"
    )


def single_nodes(nodes: DataFrame) -> DataFrame:
    """nodes with one row each, null texts and roles as empty."""
    own = Window.partitionBy("tree", "node").orderBy("parent", "score", "role", "text")
    named = nodes.filter("node is not null").select("tree", "node", "parent", "score", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return named.withColumn("no", F.row_number().over(own)).filter("no = 1").drop("no")


def _same(a: str, b: str, left: str = "node", right: str = "node"):
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def paths(links: DataFrame) -> DataFrame:
    """(tree, node, parent, one row a node) -> (tree, leaf, node, up) for every node on the path from each leaf to its root; up = 0 at the leaf."""
    parents = links.filter("parent is not null").alias("n").join(links.alias("p"), _same("n", "p", "parent"), "left_semi")
    jumps = [cut(parents.select("tree", "node", F.col("parent").alias("anc")))]
    n = jumps[0].count()
    # the 2**k-th ancestors; whoever still has one when 2**k exceeds all links hangs on a cycle
    while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) <= n:
        far = jumps[-1].alias("a").join(jumps[-1].alias("b"), _same("a", "b", "anc"))
        jumps.append(cut(far.select("a.tree", "a.node", F.col("b.anc").alias("anc"))))
    inner = jumps[0].select("tree", F.col("anc").alias("node")).distinct()
    leaves = links.alias("n").join(inner.alias("p"), _same("n", "p"), "left_anti").join(jumps[-1].alias("c"), _same("n", "c"), "left_anti")
    reach = cut(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    for k, jump in enumerate(jumps[:-1]):
        more = reach.alias("r").join(jump.alias("j"), _same("r", "j"))
        reach = cut(reach.unionByName(more.select("r.tree", "r.leaf", F.col("j.anc").alias("node"), (F.col("r.up") + (1 << k)).alias("up"))))
    return reach


def ranked_branches(links: DataFrame, reach: DataFrame, branches: int | None) -> DataFrame:
    """(tree, leaf, rank): branches by the sum of scores on the path, best first."""
    scored = reach.alias("r").join(links.select("tree", "node", "score").alias("n"), _same("r", "n"))
    totals = scored.groupBy("r.tree", "r.leaf").agg(F.sum(F.coalesce("n.score", F.lit(0.0))).alias("branch_score"), F.count("*").alias("n_turns"))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    ranked = totals.select("tree", "leaf", "branch_score", "n_turns").withColumn("rank", F.row_number().over(order))
    return ranked if branches is None else ranked.filter(F.col("rank") <= branches)


def format_trees(nodes: DataFrame, branches: int | None = None) -> DataFrame:
    """One row a chosen path: tree, leaf, rank, branch_score, n_turns, formatted, loss_spans."""
    nodes = single_nodes(nodes)
    links = cut(nodes.select("tree", "node", "parent", "score"))
    reach = paths(links)
    chosen = cut(ranked_branches(links, reach, branches))
    turns = (
        reach.alias("r").join(chosen.alias("c"), _same("r", "c", "leaf", "leaf")).join(nodes.alias("n"), _same("r", "n"))
        .select("r.tree", "r.leaf", "c.rank", "c.branch_score", "c.n_turns", (F.col("c.n_turns") - 1 - F.col("r.up")).alias("pos"), "n.role", "n.text")
        .withColumn("piece", format_turn(F.col("role"), F.col("text")))
    )
    so_far = Window.partitionBy("tree", "leaf").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(so_far), F.lit(0)) + header_length(F.col("role"))
    spanned = turns.withColumn("start", start).withColumn("end", F.col("start") + F.length(escape(F.col("text"))))
    key = ["tree", "leaf", "rank", "branch_score", "n_turns"]
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))
    blocks = spanned.groupBy(*key, F.floor(F.col("pos") / BLOCK).alias("block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "").alias("piece"),
        F.array_sort(F.collect_list(span)).alias("spans"),
    )
    whole = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", "piece", "spans"))).alias("b"))
    return whole.select(
        *key,
        F.array_join(F.transform("b", lambda x: x["piece"]), "").alias("formatted"),
        F.flatten(F.transform("b", lambda x: x["spans"])).alias("loss_spans"),
    )


def parse_turns(formatted):
    """The turns of a formatted conversation: array of (role, text)."""
    parts = F.split(formatted, r"\n</turn>\n")
    head = lambda t: F.substring_index(t, ":\n", 1)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda t: F.struct(
            F.url_decode(F.substring(head(t), 5, 1 << 30)).alias("role"),
            unescape(t.substr(F.length(head(t)) + 3, F.length(t))).alias("text"),
        ),
    )


def loss_text(formatted, loss_spans):
    """The texts under the loss mask, cut out of the formatted conversation and unescaped."""
    cut_out = lambda s: formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.array_join(F.transform(loss_spans, lambda s: unescape(cut_out(s))), "")
