"""The corpus as its own dictionary: token counts, and repair of unattested tokens.

A token that the lexicon holds is its own nearest, so only unattested ones are looked up,
each once a document. They meet the document's words in blocks of one length and a bounded
number of words (see ``similarity.nearest_words``); only each block's best goes on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemend.functions.similarity import nearest_words
from pagemend.functions.text import all_digits, has_identifier, has_numeric_field, is_cosmetic, tokens
from pagemend.schema import CLEAN_CONF, LEXICON_LENGTH_GAP, LEXICON_RATIO, TOKEN_LENGTH, lines_of

LINE_KEY = ["document_id", "page_ord", "line_no"]


def eligible(c):
    return (F.length(c) >= TOKEN_LENGTH) & ~all_digits(c)


def build_lexicon(pages: DataFrame) -> DataFrame:
    """(document_id, token, freq, first): tokens of clean lines, with where each was first read."""
    clean = lines_of(pages).filter(F.col("conf") >= CLEAN_CONF)
    flat = clean.select("document_id", "page_ord", "line_no", F.posexplode(tokens("text")).alias("tok_no", "token")).filter(eligible("token"))
    return flat.groupBy("document_id", "token").agg(F.count("*").alias("freq"), F.min(F.struct("page_ord", "line_no", "tok_no")).alias("first"))


def _dealt(asked: DataFrame, lexicon: DataFrame, gap: int) -> tuple[DataFrame, DataFrame]:
    """Both sides by (document_id, size, part, deal): a block holds the words of one length, in bounded parts.

    A document's words of one length are dealt over parts, and so are the tokens that ask
    for them; every deal of tokens meets every part of words once.
    """
    words = lexicon.select("document_id", F.col("token").alias("other"), F.length("token").alias("size"), *[F.col(f"first.{c}").alias(c) for c in PLACE])
    sizes = F.explode(F.sequence(F.greatest(F.lit(TOKEN_LENGTH), F.length("token") - gap), F.length("token") + gap)).alias("size")
    tokens = asked.select("document_id", "token", sizes)
    key = ["document_id", "size"]
    parts = words.groupBy(*key).agg(F.ceil(F.count("*") / WORDS_A_PART).cast("int").alias("parts"))
    deals = tokens.groupBy(*key).agg(F.ceil(F.count("*") / TOKENS_A_DEAL).cast("int").alias("deals"))
    grid = parts.join(deals, key)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = tokens.join(grid, key).withColumn("deal", own("token", "deals")).withColumn("part", every("parts"))
    right = words.join(grid, key).withColumn("part", own("other", "parts")).withColumn("deal", every("deals"))
    # names of their own, as both sides may come from one table
    renamed = [F.col(c).alias(f"b_{c}") for c in BLOCK]
    return left.select(*renamed, "token"), right.select(*renamed, "other", *PLACE)


def _nearest(min_ratio: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, others = left["token"].to_pylist(), right["other"].to_pylist()
        places = list(zip(*(right[c].to_pylist() for c in PLACE), strict=True))
        found = nearest_words(asked, others, places, min_ratio)
        doc = left["b_document_id"][0].as_py() if found else None
        rows = [(doc, asked[i], others[j], value, *places[j]) for i, value, j in found]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_FOUND)
        return pa.table([pa.array(c, k) for c, k in zip(cols, _FOUND.types, strict=True)], schema=_FOUND)

    return run


PLACE = ("page_ord", "line_no", "tok_no")
BLOCK = ("document_id", "size", "part", "deal")
#: A block holds at most about so many words and tokens. A token's work hardly grows with the words of its block.
WORDS_A_PART = 100_000
TOKENS_A_DEAL = 40_000
_FOUND = pa.schema([("document_id", pa.string()), ("token", pa.string()), ("other", pa.string()), ("ratio", pa.float64()), *[(c, pa.int64()) for c in PLACE]])


def closest(asked: DataFrame, lexicon: DataFrame, min_ratio: float = LEXICON_RATIO, gap: int = LEXICON_LENGTH_GAP) -> DataFrame:
    """(document_id, token, best) for asked tokens with a neighbour at ``min_ratio``; the first read wins ties."""
    probes = asked.select("document_id", "token").distinct().join(lexicon.select("document_id", "token"), ["document_id", "token"], "left_anti")
    left, right = _dealt(probes, lexicon, gap)
    schema = "document_id string, token string, other string, ratio double, " + ", ".join(f"{c} long" for c in PLACE)
    key = [f"b_{c}" for c in BLOCK]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_nearest(min_ratio), schema)
    return found.groupBy("document_id", "token").agg(F.min_by("other", F.struct(-F.col("ratio"), *PLACE)).alias("best"))


def repair(lines: DataFrame, lexicon: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(document_id, page_ord, line_no, repaired, guard, naive, vouched) of low-confidence lines.

    ``repaired`` is null unless letters change. ``guard`` (numeric or identifier) is set where
    it kept a line from changing to ``naive``; ``vouched`` lists (tok_no, token, best) of known
    tokens that had a neighbour. known: (token), lower-cased.
    """
    flat = lines.select(*LINE_KEY, F.posexplode(tokens("text")).alias("tok_no", "token"))
    nearest = closest(flat.filter(eligible("token")), lexicon)
    told = flat.join(nearest, ["document_id", "token"], "left")
    if known is None:
        told = told.withColumn("known", F.lit(False))
    else:
        terms = known.select(F.col("token").alias("__low"), F.lit(True).alias("known"))
        told = told.withColumn("__low", F.lower("token")).join(terms, "__low", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    free = F.coalesce("best", "token")
    words = told.groupBy(*LINE_KEY).agg(
        F.array_sort(F.collect_list(F.struct("tok_no", free.alias("free"), F.when(F.col("known"), F.col("token")).otherwise(free).alias("kept")))).alias("w"),
        F.array_sort(F.collect_list(F.when(F.col("known") & F.col("best").isNotNull(), F.struct("tok_no", "token", "best")))).alias("vouched"),
    )
    joined = lines.select(*LINE_KEY, "text").join(words, LINE_KEY, "left")
    text = lambda field: F.coalesce(F.array_join(F.transform("w", lambda x: x[field]), " "), F.lit(""))
    held = F.when(has_numeric_field("text"), "numeric").when(has_identifier("text"), "identifier")
    repaired, naive = text("kept"), text("free")
    changed = held.isNull() & (repaired != F.col("text")) & ~is_cosmetic("text", repaired)
    saved = held.isNotNull() & (naive != F.col("text"))
    return joined.select(
        *LINE_KEY,
        F.when(changed, repaired).alias("repaired"),
        F.when(saved, held).alias("guard"),
        F.when(saved, naive).alias("naive"),
        F.when(held.isNull(), F.col("vouched")).alias("vouched"),
    )
