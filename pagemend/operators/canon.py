"""Evidence that a corpus votes on: counts of texts, slot and line canonicals.

All of it depends on raw lines only, so it is computed before any line changes. Counts are
partial sums before the shuffle; a hot cluster or text is a few rows a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemend.functions.similarity import ratio
from pagemend.functions.text import has_numeric_field
from pagemend.schema import (
    CLEAN_CONF,
    CONF_GATE,
    MIN_CLEAN_SIBLINGS,
    MIN_LINE_LENGTH,
    NEAR_MISS_FRACTION,
    NEAR_MISS_LENGTH_GAP,
    NEAR_MISS_RATIO,
    PROFILE_SUPPORT,
    SLOT_DEPTH,
    TIE_FACTOR,
    lines_of,
)

from .blocking import near_pairs
from .cluster import CLUSTER
from .lexical import Plausibility

SLOT = [*CLUSTER, "side", "k"]


def text_counts(clustered: DataFrame, gate: float = CONF_GATE) -> DataFrame:
    """(cluster, text, n, n_clean, n_confident, first): every reading of a text in a cluster."""
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return lines_of(clustered).groupBy(*CLUSTER, "text").agg(
        F.count("*").alias("n"),
        one(F.col("conf") >= CLEAN_CONF).alias("n_clean"),
        one(F.col("conf") >= gate).alias("n_confident"),
        F.min(F.struct("page_ord", "line_no")).alias("first"),
    )


def slot_entries(pages: DataFrame, keep, text, depth: int = SLOT_DEPTH) -> DataFrame:
    """(cluster, side, k, text) of the kept first and last lines of each page; a short page gives both."""
    n = F.size("lines")
    places = F.when(n > 0, F.sequence(F.lit(0), F.least(F.lit(depth), n) - 1)).otherwise(F.array().cast("array<int>"))
    entry = lambda side, at: F.transform(places, lambda k: F.struct(F.lit(side).alias("side"), k.alias("k"), F.get("lines", at(k)).alias("l")))
    flat = pages.select(*CLUSTER, F.explode(F.concat(entry("top", lambda k: k), entry("bottom", lambda k: n - 1 - k))).alias("e"))
    return flat.select(*CLUSTER, "e.side", "e.k", "e.l.*").filter(keep).select(*SLOT, text.alias("text"))


def slot_tally(clustered: DataFrame) -> DataFrame:
    """(cluster, side, k, text, n): clean readings without figures of each slot."""
    clean = (F.col("conf") >= CLEAN_CONF) & ~has_numeric_field("text")
    return slot_entries(clustered, clean, F.col("text")).groupBy(*SLOT, "text").agg(F.count("*").alias("n"))


def choose(tally: DataFrame, key: list[str], plausible=None) -> DataFrame:
    """(key, text, support): the modal text of each key.

    The most frequent, ties to the smaller text. With ``plausible`` (a ``lexical.Plausibility``,
    or a function from a text column to a score), texts within the tie factor of the most
    frequent are ranked by score, then count, then the greater text.
    """
    first = tally.groupBy(*key).agg(F.min_by("text", F.struct(-F.col("n"), F.col("text"))).alias("text"), F.max("n").alias("support"))
    if plausible is None:
        return first
    best = tally.groupBy(*key).agg(F.max("n").alias("__best"))
    close = tally.join(best, key).filter(F.col("n") * TIE_FACTOR >= F.col("__best"))
    if isinstance(plausible, Plausibility) and plausible.known is None and plausible.frequencies is None:
        score = F.lit(0.0)  # no word is known: counts and texts decide
    elif isinstance(plausible, Plausibility):
        close, score = close.join(plausible.scores(close), "text"), F.col("p")
    else:
        score = plausible("text")
    rank = F.struct(score.alias("p"), F.col("n").alias("n"), F.col("text").alias("t"))
    top = close.groupBy(*key).agg(F.max(rank).alias("r"))
    return top.select(*key, F.col("r.t").alias("text"), F.col("r.n").alias("support"))


def slot_canon(clustered: DataFrame, plausible=None) -> DataFrame:
    """(cluster, side, k, text, support)."""
    return choose(slot_tally(clustered), SLOT, plausible)


def drop_near_misses(tally: DataFrame, key: list[str], min_support: int = MIN_CLEAN_SIBLINGS) -> DataFrame:
    """The tally (key, text, n) without rare texts that a far more frequent near-twin contradicts."""
    allowed = lambda n: F.greatest(F.lit(1), F.floor(n * NEAR_MISS_FRACTION))
    # only texts that can contradict the rarest of the cluster, and counts at which one of them can, take part
    rarest = tally.groupBy(*key).agg(F.min("n").alias("__low"))
    frequent = tally.filter(F.col("n") >= min_support).join(rarest, key).filter((F.col("n") > F.col("__low")) & (allowed(F.col("n")) >= F.col("__low")))
    frequent = frequent.select(*key, F.col("text").alias("other"), F.col("n").alias("other_n"))
    room = frequent.groupBy(*key).agg(F.max("other_n").alias("__top"))
    probes = tally.join(room, key).filter((F.col("n") < F.col("__top")) & (F.col("n") <= allowed(F.col("__top")))).select(*key, "text")
    pairs = near_pairs(probes, frequent.select(*key, "other"), key, NEAR_MISS_LENGTH_GAP, NEAR_MISS_RATIO, 1)
    judged = pairs.join(tally, [*key, "text"]).join(frequent, [*key, "other"])
    judged = judged.filter((F.col("other_n") > F.col("n")) & (F.col("n") <= allowed(F.col("other_n"))))
    contradicted = judged.withColumn("__r", ratio("text", "other", NEAR_MISS_RATIO)).filter(F.col("__r") >= NEAR_MISS_RATIO)
    return tally.join(contradicted.select(*key, "text").distinct(), [*key, "text"], "left_anti")


def line_index(counts: DataFrame) -> DataFrame:
    """(cluster, text, support, ord): standing lines, read clean often enough, near misses dropped.

    Texts under the minimum support can't stay and contradict no one, so they go first.
    """
    tally = counts.filter((F.col("n_clean") >= MIN_CLEAN_SIBLINGS) & (F.length("text") >= MIN_LINE_LENGTH))
    kept = drop_near_misses(tally.select(*CLUSTER, "text", F.col("n_clean").alias("n")), CLUSTER)
    order = F.struct(F.lit(0).alias("asserted"), (-F.col("n")).alias("by"), F.col("text").alias("t"))
    return kept.select(*CLUSTER, "text", F.col("n").alias("support"), order.alias("ord"))


def assert_slots(slots: DataFrame, clusters: DataFrame, profile_slots: DataFrame) -> DataFrame:
    """Voted slot canonicals with a profile's (cluster_key, side, k, text) over them."""
    asserted = clusters.select(*CLUSTER).join(profile_slots, "cluster_key").select(*SLOT, "text", F.lit(PROFILE_SUPPORT).cast("long").alias("support"))
    return slots.join(asserted, SLOT, "left_anti").unionByName(asserted)


def assert_lines(index: DataFrame, clusters: DataFrame, profile_lines: DataFrame) -> DataFrame:
    """Standing lines with those of a profile (cluster_key, pos, text) that weren't voted, after them."""
    asserted = clusters.select(*CLUSTER).join(profile_lines, "cluster_key").join(index, [*CLUSTER, "text"], "left_anti")
    order = F.struct(F.lit(1).alias("asserted"), F.col("pos").cast("long").alias("by"), F.col("text").alias("t"))
    return index.unionByName(asserted.select(*CLUSTER, "text", F.lit(PROFILE_SUPPORT).cast("long").alias("support"), order.alias("ord")))
