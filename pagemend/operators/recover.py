"""Boilerplate recovery of low-confidence lines from slot and line canonicals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemend.functions.similarity import ratio
from pagemend.functions.text import anchored, figure_safe, is_cosmetic, strip
from pagemend.schema import COMPATIBLE_RATIO, MIN_CLEAN_SIBLINGS, MIN_PREFIX

from .cluster import CLUSTER
from .lexical import vouched_texts
from .openings import longest_opening

LINE_KEY = ["document_id", "page_ord", "line_no"]


def slot_candidates(low: DataFrame, slots: DataFrame, min_support: int = MIN_CLEAN_SIBLINGS, least_ratio: float | None = COMPATIBLE_RATIO) -> DataFrame:
    """low lines with ``slot_text``: the compatible canonical of their slot from either end, most support first.

    Compatible: a shared anchor token, or (unless least_ratio is None) that similarity.
    """
    strong = slots.filter(F.col("support") >= min_support)
    side = lambda name: strong.filter(F.col("side") == name).select(*CLUSTER, F.col("k").alias(f"__{name}"), F.struct("support", "text").alias(f"__{name}_c"))
    placed = low.withColumn("__top", F.col("line_no")).withColumn("__bottom", F.col("n_lines") - 1 - F.col("line_no"))
    both = placed.join(side("top"), [*CLUSTER, "__top"], "left").join(side("bottom"), [*CLUSTER, "__bottom"], "left")
    out = both
    for name in ("top", "bottom"):
        text, own = F.col(f"__{name}_c.text"), F.col("text")
        blank = (strip(own) == "") | (strip(text) == "")
        out = out.withColumn(f"__{name}_ok", ~blank & anchored(own, text) & (text != own))
        if least_ratio is not None:  # the ratio of long lines is dear: only where no anchor has told
            asked = F.when(~F.col(f"__{name}_ok") & ~blank & (text != own), strip(own))
            alike = F.coalesce(ratio(asked, strip(text), least_ratio) >= least_ratio, F.lit(False))
            out = out.withColumn(f"__{name}_ok", F.col(f"__{name}_ok") | alike)
    found = [F.when(F.coalesce(F.col(f"__{name}_ok"), F.lit(False)), F.col(f"__{name}_c")) for name in ("top", "bottom")]
    best = F.array_max(F.array_compact(F.array(*found)))
    return out.withColumn("slot_text", best["text"]).select(*low.columns, "slot_text")


def prefix_candidates(low: DataFrame, index: DataFrame, min_prefix: int = MIN_PREFIX) -> DataFrame:
    """(cluster, text, prefix_text): the standing line with the longest common prefix, first in the index on ties."""
    lines = index.select(*CLUSTER, F.col("text").alias("other"), "ord")
    return longest_opening(low.select(*CLUSTER, "text"), lines, CLUSTER, min_prefix).withColumnRenamed("other", "prefix_text")


def recover(low: DataFrame, slots: DataFrame, index: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """low lines with ``boilerplate`` (the new text or null), ``guard`` and ``refused`` (what a guard stopped). known: (token)."""
    placed = slot_candidates(low, slots).join(prefix_candidates(low, index), [*CLUSTER, "text"], "left")
    placed = placed.select(*low.columns, F.coalesce("slot_text", "prefix_text").alias("__new"))
    text, new, guard = F.col("text"), F.col("__new"), F.col("guard")
    vouched = F.lit(False)
    if known is not None:
        asked = placed.filter("__new is not null").select("text")
        placed = placed.join(vouched_texts(asked, known).withColumn("__vouched", F.lit(True)), "text", "left")
        vouched = F.coalesce("__vouched", F.lit(False))
    held = F.when(new.isNotNull(), F.when(vouched, "known").when(~figure_safe(text, new), "figure"))
    guarded = placed.withColumn("guard", held)
    fix = F.when(guard.isNull() & new.isNotNull() & ~is_cosmetic(text, new), new)
    return guarded.select(*low.columns, fix.alias("boilerplate"), "guard", F.when(guard.isNotNull(), new).alias("refused"))
