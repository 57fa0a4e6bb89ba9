"""Recognized pages as a stream, corrected against a fixed profile (an extension).

A stream can't vote on lines it hasn't seen, so each micro-batch is corrected as a set of
documents of its own, with a profile's canonicals asserted. Dumps land as JSON files; one
file is one document, so that no state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemend.plans.correct import correct
from pagemend.sources.cached import dumps_to_pages


def watch(spark: SparkSession, folder: str) -> DataFrame:
    """(document_id, json) of dumps as they land in a folder."""
    stream = spark.readStream.format("text").option("wholetext", "true").load(folder)
    return stream.select(F.col("_metadata.file_path").alias("document_id"), F.col("value").alias("json"))


def correct_stream(dumps: DataFrame, sink: str, checkpoint: str, profile=None, **options):
    """Start a query that writes corrected lines as Parquet below ``sink``, a folder a batch."""

    def each(batch: DataFrame, number: int) -> None:
        out = correct(dumps_to_pages(batch), profile=profile, **options)
        out.lines.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return dumps.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
