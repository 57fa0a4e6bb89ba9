"""Completed review files as rules: rows with a corrected text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemend.functions.text import rule_id, strip
from pagemend.schema import REVIEW_COLUMNS
from pagemend.sinks.text import delimiter_for


def rules_and_warnings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: ``number`` (of the row in its file) and review columns as strings, any of them missing.

    Returns rules (ord, page, original, corrected, scope, stated_id) and warnings (number, warning).
    """
    cell = lambda c: strip(F.replace(F.coalesce(F.col(c) if c in rows.columns else F.lit(""), F.lit("")), F.lit("\r"), F.lit("")))
    clean = rows.select("number", *[cell(c).alias(c) for c in ("corrected_text", "original_text", "page", "scope", "rule_id")]).filter("corrected_text <> ''")
    scope = F.when(F.lower("scope") == "", "page").otherwise(F.lower("scope"))
    stated = clean.select("number", "corrected_text", "original_text", "page", "rule_id", scope.alias("scope"))
    page = F.when(F.col("page").rlike(r"^\p{IsDigit}+$"), F.col("page").cast("int"))
    usable = (F.col("original_text") != "") & page.isNotNull()
    known = F.col("scope").isin("page", "all")
    said = lambda *parts: F.concat(F.lit("row "), F.col("number").cast("string"), F.lit(": "), *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    quote = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    warn = F.array_compact(F.array(
        F.when(F.col("original_text") == "", said("correction given with no original_text")),
        F.when((F.col("original_text") != "") & page.isNull(), said("page is not a number")),
        F.when(usable & ~known, said("unknown scope ", quote("scope"), ", using 'page'")),
        F.when(usable & (F.col("rule_id") != "") & (F.col("rule_id") != rule_id(page, "original_text")), said("rule_id ", quote("rule_id"), " does not match original_text; the spreadsheet may have altered the text")),
    ))
    rules = stated.filter(usable).select(
        F.col("number").alias("ord"), page.alias("page"), F.col("original_text").alias("original"), F.col("corrected_text").alias("corrected"),
        F.when(known, F.col("scope")).otherwise("page").alias("scope"), F.col("rule_id").alias("stated_id"),
    )
    return rules, stated.select("number", F.explode(warn).alias("warning")).orderBy("number")


def load_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Rules and warnings of a review file (.csv: commas, else tabs). Its rows are one person's work, numbered in file order."""
    rows = spark.read.csv(path, sep=delimiter_for(path), header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    have = [c for c in REVIEW_COLUMNS if c in rows.columns]
    numbered = rows.coalesce(1).select((F.monotonically_increasing_id() + 2).cast("int").alias("number"), *[F.col(c).cast("string") for c in have])
    return rules_and_warnings(numbered)
