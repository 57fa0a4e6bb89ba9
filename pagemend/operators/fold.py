"""Folding of non-ASCII characters, where the corpus attests the plain spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemend.functions.similarity import drop_non_ascii, fold_marks
from pagemend.functions.text import strip
from pagemend.schema import MIN_CLEAN_SIBLINGS

from .cluster import CLUSTER

EVIDENCE, FORCE, OFF = "evidence", "force", "off"


def candidates(text, folded):
    """Plainer spellings, nearest first: marks dropped, then everything else that isn't ASCII."""
    plain = drop_non_ascii(folded)
    return F.filter(F.array_distinct(F.array(folded, plain)), lambda c: (c != text) & (strip(c) != ""))


def fold_texts(texts: DataFrame, counts: DataFrame, mode: str = EVIDENCE, min_support: int = MIN_CLEAN_SIBLINGS) -> DataFrame:
    """(cluster, text) distinct -> (cluster, text, plain, own): the spelling to use, and how often the text itself is read.

    ``counts`` (cluster, text, n) is joined once, with every spelling asked about.
    """
    asked = texts.filter(F.col("text").rlike(r"[^\x00-\x7F]")).withColumn("__folded", fold_marks("text"))
    if mode == FORCE:
        forced = drop_non_ascii("__folded")
        plain = F.when(strip(forced) != "", forced).otherwise(F.col("text"))
        return asked.select(*CLUSTER, "text", plain.alias("plain"), F.lit(0).cast("long").alias("own"))
    spelled = asked.select(*CLUSTER, "text", F.posexplode(F.concat(F.array("text"), candidates(F.col("text"), F.col("__folded")))).alias("place", "spelling"))
    read = counts.select(*CLUSTER, F.col("text").alias("spelling"), "n")
    support = spelled.join(read, [*CLUSTER, "spelling"], "inner").groupBy(*CLUSTER, "text").agg(
        F.coalesce(F.max(F.when(F.col("place") == 0, F.col("n"))), F.lit(0)).alias("own"),
        F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "spelling", "n")))).alias("c"),
    )
    chosen = F.filter("c", lambda c: (c["n"] >= min_support) & (c["n"] > F.col("own")))
    out = texts.filter(F.col("text").rlike(r"[^\x00-\x7F]")).join(support, [*CLUSTER, "text"], "left")
    return out.select(*CLUSTER, "text", F.coalesce(F.get(chosen, F.lit(0))["spelling"], F.col("text")).alias("plain"), F.coalesce("own", F.lit(0)).cast("long").alias("own"))


def with_plain(lines: DataFrame, counts: DataFrame, c: str, mode: str = EVIDENCE, min_support: int = MIN_CLEAN_SIBLINGS) -> DataFrame:
    """lines (cluster, c, ...) with ``plain`` and ``own`` as ``fold_texts`` gives them, null where c is ASCII.

    Three equality joins of the lines themselves, so that nothing is computed twice.
    """
    text, asked = F.col(c), F.col(c).rlike(r"[^\x00-\x7F]")
    folded = lines.withColumn("__folded", F.when(asked, fold_marks(c)))
    if mode == FORCE:
        forced = drop_non_ascii("__folded")
        return folded.withColumn("plain", F.when(asked, F.when(strip(forced) != "", forced).otherwise(text))).withColumn("own", F.when(asked, F.lit(0).cast("long"))).drop("__folded")
    spelled = folded.withColumn("__c", candidates(text, F.col("__folded")))
    # lines without a candidate look themselves up, which spreads them as their texts do
    keyed = spelled.withColumn("__k0", text).withColumn("__k1", F.coalesce(F.get("__c", F.lit(0)), text)).withColumn("__k2", F.coalesce(F.get("__c", F.lit(1)), text))
    for i in range(3):
        keyed = keyed.join(counts.select(*CLUSTER, F.col("text").alias(f"__k{i}"), F.col("n").alias(f"__n{i}")), [*CLUSTER, f"__k{i}"], "left")
    own = F.coalesce("__n0", F.lit(0)).cast("long")
    attested = [F.when((F.col(f"__k{i}") != text) & (F.col(f"__n{i}") >= min_support) & (F.col(f"__n{i}") > own), F.col(f"__k{i}")) for i in (1, 2)]
    return keyed.select(*lines.columns, F.when(asked, F.coalesce(*attested, text)).alias("plain"), F.when(asked, own).alias("own"))
