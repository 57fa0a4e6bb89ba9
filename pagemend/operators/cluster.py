"""Pages by layout format, and what each format cluster may vote on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemend.functions.text import FORMATS, page_format
from pagemend.schema import MIN_CLUSTER_PAGES

CLUSTER = ["document_id", "cluster_key"]


def cluster_pages(pages: DataFrame, formats=FORMATS) -> DataFrame:
    """pages with ``cluster_key``. A signature may straddle two lines, so lines are joined first.

    Lines are nested in their page, so this is a projection: no shuffle. Pages that have a
    ``cluster_key`` already keep it.
    """
    if "cluster_key" in pages.columns:
        return pages
    blob = F.array_join(F.transform("lines", lambda x: F.coalesce(x["text"], F.lit(""))), " ")
    return pages.withColumn("cluster_key", page_format(blob, formats))


def cluster_info(clustered: DataFrame, profile_clusters: DataFrame | None = None) -> DataFrame:
    """(document_id, cluster_key, n_pages, can_vote); a page without lines counts."""
    counts = clustered.groupBy(*CLUSTER).agg(F.count("*").alias("n_pages"))
    if profile_clusters is None:
        return counts.withColumn("can_vote", F.col("n_pages") >= MIN_CLUSTER_PAGES)
    asserted = profile_clusters.select("cluster_key").distinct().withColumn("__has", F.lit(True))
    voted = counts.join(asserted, "cluster_key", "left")
    return voted.select(*CLUSTER, "n_pages", (F.coalesce("__has", F.lit(False)) | (F.col("n_pages") >= MIN_CLUSTER_PAGES)).alias("can_vote"))
