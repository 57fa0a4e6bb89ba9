"""Newline-delimited lists of terms: known patterns and error patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemend.functions.text import strip


def term_of(line) -> Column:
    """The term on a line, or '': comments start at a # after white space, or at the line's start."""
    line = F.regexp_replace(F.col(line) if isinstance(line, str) else line, "^﻿", "")
    return F.when(strip(line).startswith("#"), "").otherwise(strip(F.regexp_replace(line, r"[ \t]#.*$", "")))


def load_terms(spark: SparkSession, path: str) -> DataFrame:
    """(ord, term) in file order. Files are operators' lists, read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\n|\r")).alias("ord", "line"))
    return whole.select("ord", term_of("line").alias("term")).filter("term <> ''")
