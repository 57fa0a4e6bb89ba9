"""Confident lines that the corpus contradicts: rare near-twins of frequent texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemend.functions.similarity import ratio
from pagemend.functions.text import classify, common_prefix, figure_safe, has_date, strip
from pagemend.plans.cut import cut, small
from pagemend.schema import (
    DISAGREE_RATIO,
    MAX_LENGTH_GAP,
    MAX_VARIANT_FRACTION,
    MIN_CLEAN_SIBLINGS,
    MIN_DISAGREE_LENGTH,
    PREFIX_MIN_CHARS,
    PREFIX_MIN_FRACTION,
)

from .blocking import near_pairs
from .cluster import CLUSTER


def canonical_counts(counts: DataFrame, clusters: DataFrame, profile_lines: DataFrame | None = None) -> DataFrame:
    """(cluster, canonical, support, ord): texts that a cluster agrees on, then a profile's lines."""
    least = F.greatest(F.lit(MIN_CLEAN_SIBLINGS), F.floor(F.col("n_pages") / 4)).cast("long")
    sized = clusters.select(*CLUSTER, least.alias("least"))
    voted = counts.filter((F.length("text") >= MIN_DISAGREE_LENGTH) & (F.col("n") >= MIN_CLEAN_SIBLINGS)).join(sized, CLUSTER).filter("n >= least")
    order = F.struct(F.lit(0).alias("asserted"), F.col("first.page_ord").cast("long").alias("a"), F.col("first.line_no").cast("long").alias("b"))
    out = voted.select(*CLUSTER, F.col("text").alias("canonical"), F.col("n").alias("support"), order.alias("ord"), "least")
    if profile_lines is None:
        return out
    own = F.struct(F.lit(1).alias("asserted"), F.col("pos").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    asserted = sized.join(profile_lines, "cluster_key").select(*CLUSTER, F.col("text").alias("canonical"), F.col("least").alias("support"), own.alias("ord"), "least")
    return out.unionByName(asserted.join(out, [*CLUSTER, "canonical"], "left_anti"))


def prefix_pairs(texts: DataFrame, canon: DataFrame, sent=lambda df: df) -> DataFrame:
    """(cluster, text, other, shared): canonicals that open like the text, by equality of the first characters.

    A canonical is read on a quarter of a cluster's pages, so a cluster has at most four times
    the lines of a mean page of them: a text meets no more, however hot the opening is.
    """
    head = lambda c: F.substring(strip(c), 1, PREFIX_MIN_CHARS)
    long_enough = lambda c: F.length(strip(c)) >= PREFIX_MIN_CHARS
    left = texts.filter(long_enough("text")).withColumn("__h", head("text"))
    right = canon.filter(long_enough("other")).withColumn("__h", head("other"))
    pairs = left.join(sent(right), [*CLUSTER, "__h"]).filter(strip("text") != strip("other"))
    near = pairs.withColumn("shared", common_prefix(strip("text"), strip("other")))
    return near.filter(F.col("shared") >= PREFIX_MIN_FRACTION * F.length(strip("other"))).drop("__h")


def eligible():
    """Of a row text, seen, other, support: the canonical may judge the text."""
    return ~has_date("other") & (F.col("seen") <= F.greatest(F.lit(1), F.floor(F.col("support") * MAX_VARIANT_FRACTION))) & figure_safe("text", "other")


def disagreeing_texts(counts: DataFrame, canon: DataFrame, min_ratio: float = DISAGREE_RATIO) -> DataFrame:
    """(cluster, text, canonical, kind): each distinct confident text with its nearest canonical.

    By whole similarity first; texts without such a neighbour by their opening. Canonicals are
    few as a rule, and then go to where the texts are.
    """
    other = cut(canon.select(*CLUSTER, F.col("canonical").alias("other"), "support", "ord"))
    sent = small(other, "other")
    probes = counts.filter((F.col("n_confident") > 0) & (F.length("text") >= MIN_DISAGREE_LENGTH) & ~has_date("text"))
    probes = probes.join(sent(other.select(*CLUSTER, F.col("other").alias("text"))), [*CLUSTER, "text"], "left_anti").select(*CLUSTER, "text", F.col("n").alias("seen"))
    pairs = near_pairs(probes, other.select(*CLUSTER, "other"), CLUSTER, MAX_LENGTH_GAP, min_ratio, MIN_DISAGREE_LENGTH, sent)
    judged = pairs.join(sent(other), [*CLUSTER, "other"]).filter(eligible())
    scored = judged.withColumn("__r", ratio("text", "other", min_ratio)).filter(F.col("__r") > min_ratio)
    whole = scored.groupBy(*CLUSTER, "text").agg(F.min_by("other", F.struct(-F.col("__r"), F.col("ord"))).alias("canonical"))
    opened = prefix_pairs(probes, other, sent).filter(eligible())
    by_prefix = opened.groupBy(*CLUSTER, "text").agg(F.min_by("other", F.struct(-F.col("shared"), F.col("ord"))).alias("canonical"))
    by_prefix = by_prefix.join(whole.select(*CLUSTER, "text"), [*CLUSTER, "text"], "left_anti")
    return whole.unionByName(by_prefix).withColumn("kind", classify("text", "canonical"))
