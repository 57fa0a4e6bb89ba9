"""Recognizer dumps: JSON objects of page number -> {txts, scores}, one file a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemend.schema import BOX, LINE

ENTRY = "txts array<string>, scores array<double>"


def _entries(raw) -> Column:
    return F.from_json(raw, "map<string, string>")


def dumps_to_pages(dumps: DataFrame) -> DataFrame:
    """(document_id, json) -> pages in order of their numbers.

    Entries that aren't objects are skipped; texts and scores are paired up to the shorter
    list; a page without lines stays. All in one projection and a sort of each document's keys.
    """
    each = dumps.select("document_id", F.explode(_entries("json")).alias("key", "raw")).filter(F.trim("raw").startswith("{"))
    page = each.select("document_id", F.trim("key").cast("int").alias("page_number"), F.from_json("raw", ENTRY).alias("e"))
    texts, scores = F.coalesce("e.txts", F.array().cast("array<string>")), F.coalesce("e.scores", F.array().cast("array<double>"))
    n = F.least(F.size(texts), F.size(scores))
    line = lambda i: F.struct(F.get(texts, i).alias("text"), F.get(scores, i).alias("conf"), F.lit(None).cast(BOX).alias("box"))
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), line)).otherwise(F.array().cast(f"array<{LINE}>"))
    rows = page.select("document_id", "page_number", lines.alias("lines"))
    numbers = rows.groupBy("document_id").agg(F.array_sort(F.collect_list("page_number")).alias("__all"))  # page numbers only
    placed = rows.join(numbers, "document_id").withColumn("page_ord", (F.array_position("__all", F.col("page_number")) - 1).cast("int"))
    return placed.select("document_id", "page_ord", "page_number", "lines")


def load_cached(spark: SparkSession, path: str) -> DataFrame:
    """Pages of every dump at a path or glob that Spark reads; document_id is the file's address.

    ValueError for files that aren't JSON objects (Spark itself raises for a missing path).
    """
    dumps = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("document_id"), F.regexp_replace("value", "^﻿", "").alias("json"))
    valid = F.try_parse_json("json")
    bad = dumps.select("document_id", valid.isNull().alias("broken"), (F.schema_of_variant(valid)).startswith("OBJECT").alias("whole")).filter("broken or not whole").limit(1).collect()
    if bad:
        why = "is not valid JSON" if bad[0].broken else "must be a page-keyed object"
        raise ValueError(f"cached OCR {bad[0].document_id} {why}")
    return dumps_to_pages(dumps)
