"""Vocabularies as tables that are joined: known terms, word frequencies, how word-like a text is."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemend.functions.text import cores, word_tokens
from pagemend.schema import KNOWN_WEIGHT, MIN_ZIPF, WORDFREQ_WEIGHT


def token_table(spark: SparkSession, known) -> DataFrame | None:
    """(token) from a table of tokens, or from a list of them; None for neither."""
    if known is None or isinstance(known, DataFrame):
        return known
    return spark.createDataFrame([(k,) for k in dict.fromkeys(known)], "token string") if known else None


def vouched_texts(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(text): those whose alphanumeric runs, at least one, are all known, lower-cased."""
    runs = texts.select("text").distinct().select("text", F.explode(F.array_distinct(F.transform(cores("text"), F.lower))).alias("token"))
    told = runs.join(known.select("token", F.lit(True).alias("known")), "token", "left")
    return told.groupBy("text").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all")).filter("all").select("text")


def table_frequencies(zipf: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Frequencies from a table (token, zipf)."""
    return lambda words: words.join(zipf.select("token", "zipf"), "token")


def package_frequencies(language: str = "en") -> Callable[[DataFrame], DataFrame] | None:
    """Frequencies of the wordfreq package, asked for the words at hand; None without it."""
    if importlib.util.find_spec("wordfreq") is None:
        return None

    def ask(words: pa.Array) -> pa.Array:
        from wordfreq import zipf_frequency

        return pa.array([zipf_frequency(w, language) for w in words.to_pylist()], pa.float64())

    return lambda words: words.select("token", F.arrow_udf(ask, "double")(F.col("token")).alias("zipf"))


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    """(token, zipf) of a file of words and frequencies, apart by a tab; lines without a number are left out."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).select(F.lower(F.trim(F.get(parts, F.lit(0)))).alias("token"), F.get(parts, F.lit(1)).try_cast("double").alias("zipf"))
    return rows.filter("zipf is not null").groupBy("token").agg(F.max("zipf").alias("zipf"))


@dataclass
class Plausibility:
    """How word-like texts are: known terms (token) count most, attested words less, other words nothing."""

    known: DataFrame | None = None
    frequencies: Callable[[DataFrame], DataFrame] | None = None

    def scores(self, texts: DataFrame) -> DataFrame:
        """(text, p) of the distinct texts: the mean weight of their word tokens, 0 without any."""
        distinct = texts.select("text").distinct()
        words = distinct.select("text", F.explode(F.transform(word_tokens("text"), F.lower)).alias("token"))
        weight = F.lit(0.0)
        if self.frequencies is not None:
            common = self.frequencies(words.select("token").distinct()).filter(F.col("zipf") >= MIN_ZIPF).select("token", F.lit(WORDFREQ_WEIGHT).alias("__f"))
            words = words.join(common, "token", "left")
            weight = F.coalesce("__f", weight)
        if self.known is not None:
            words = words.join(self.known.select("token", F.lit(KNOWN_WEIGHT).alias("__k")), "token", "left")
            weight = F.coalesce("__k", weight)
        mean = words.groupBy("text").agg((F.sum(weight) / F.count("*")).alias("p"))
        return distinct.join(mean, "text", "left").select("text", F.coalesce("p", F.lit(0.0)).alias("p"))
