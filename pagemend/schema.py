"""Tables of the engine and the numbers that fix its results.

``pages`` is the working layout: one row a page, its lines nested in reading order, so that
line numbers are positions and a page without lines still exists::

    document_id string, page_ord int, page_number int,
    lines array<struct<text string, conf double, box struct<x0, y0, x1, y1: double>>>

``lines_of`` gives the flat view; ``pages_of`` builds pages from flat lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
LINE = f"struct<text: string, conf: double, box: {BOX}>"
PAGES = f"document_id string, page_ord int, page_number int, lines array<{LINE}>"
CHANGES = "document_id string, page_ord int, page_number int, line_no int, seq int, kind string, old string, new string"
RULES = "ord int, page int, original string, corrected string, scope string, stated_id string"
PROFILE = "struct<version: int, clusters: map<string, struct<slots: map<string, string>, lines: array<string>>>>"

# They decide results.
CONF_GATE = 0.90
CLEAN_CONF = 0.95
MIN_CLEAN_SIBLINGS = 3
MIN_CLUSTER_PAGES = 4
FIGURE_PREFIX = 20
NEAR_MISS_RATIO = 0.90
NEAR_MISS_FRACTION = 0.25
NEAR_MISS_LENGTH_GAP = 3
SLOT_DEPTH = 4
MIN_LINE_LENGTH = 18
MIN_PREFIX = 12
COMPATIBLE_RATIO = 0.25
TOKEN_LENGTH = 3
LEXICON_RATIO = 0.72
LEXICON_LENGTH_GAP = 2
DISAGREE_RATIO = 0.90
MAX_VARIANT_FRACTION = 0.25
MIN_DISAGREE_LENGTH = 8
MAX_LENGTH_GAP = 3
PREFIX_MIN_CHARS = 20
PREFIX_MIN_FRACTION = 0.40
TIE_FACTOR = 1.5
MIN_ZIPF = 1.5
KNOWN_WEIGHT = 1.0
WORDFREQ_WEIGHT = 0.6
SHORT_CORE = 6
EDITS_SHORT = 1
EDITS_LONG = 2
PROFILE_SUPPORT = 10**6
FALLBACK_DPI = 300
NO_SUPPORT = f"format cluster too small for consensus (needs {MIN_CLUSTER_PAGES} pages)"
NO_CANONICAL = f"fewer than {MIN_CLEAN_SIBLINGS} clean sibling reads for this line"
NO_CANDIDATE = "no known pattern of comparable length"
TOO_FAR = "nearest known pattern is %d edits away (budget %d)"
AMBIGUOUS = "ambiguous: %s are equally close"
DIGITS_WOULD_CHANGE = "correction would alter digits"
REVIEW_COLUMNS = ("rule_id", "file", "page", "conf", "count", "status", "original_text", "tool_text", "corrected_text", "scope", "notes")


def lines_of(pages: DataFrame) -> DataFrame:
    """One row a line, with its number and the number of lines of its page."""
    keep = [c for c in pages.columns if c != "lines"]
    flat = pages.select(*keep, F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line_no", "__l"))
    return flat.select(*keep, "n_lines", "line_no", "__l.text", "__l.conf", "__l.box")


def pages_of(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Nested pages from flat lines; ``pages`` adds those that have no lines."""
    box = F.col("box") if "box" in lines.columns else F.lit(None).cast(BOX)
    row = F.struct("line_no", F.struct(F.col("text"), F.col("conf").cast("double").alias("conf"), box.alias("box")).alias("l"))
    key = ["document_id", "page_ord"]
    nested = lines.groupBy(*key).agg(F.first("page_number").alias("page_number"), F.array_sort(F.collect_list(row)).alias("r"))
    nested = nested.select(*key, "page_number", F.transform("r", lambda x: x["l"]).alias("lines"))
    if pages is None:
        return nested
    empty = pages.select(*key, "page_number").join(nested, key, "left_anti").withColumn("lines", F.array().cast(f"array<{LINE}>"))
    return nested.unionByName(empty)
