"""Text shapes as column expressions: predicates, projections and prefixes.

Everything here but ``classify`` stays in the JVM. White space and digits are Unicode's, as U+001C..U+001F
count as white space in the reference semantics, too.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemend.functions.spelling import kinds
from pagemend.schema import EDITS_LONG, EDITS_SHORT, FALLBACK_DPI, FIGURE_PREFIX, SHORT_CORE

# The patterns decide results.
FORMAT_A = r"SHIPMENT DETAILS|BREAKDOWN OF CHARGES"
FORMAT_B = r"Our Ref No|On Board Date|Bill To"
TOKEN = r"(?U)[^\s\x1c-\x1f]+"
ANCHOR_TOKEN = r"[A-Za-z0-9]{3,}"
WORD_TOKEN = r"[A-Za-z]{3,}"
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
NON_ASCII = r"[^\x00-\x7F]"
NUMERIC_FIELD = r"(?U)\$[\s\x1c-\x1f]?\d|\d[\d,]*\.\d{2}\b|\bNo[:.]?[\s\x1c-\x1f]*\d"
DIGIT = r"(?U)\d"
CORE = r"[A-Za-z0-9]+"
IDENTIFIER = r"(?U)\d{5,}"
DATE = r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b"
#: Formats in the order in which they are tested.
FORMATS = (("B", FORMAT_B), ("A", FORMAT_A))
UNKNOWN_FORMAT = "?"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(c) -> Column:
    """Without any white space."""
    return F.regexp_replace(col(c), WHITESPACE, "")


def tokens(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(TOKEN), F.lit(0))


def cores(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(CORE), F.lit(0))


def word_tokens(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(WORD_TOKEN), F.lit(0))


def anchors(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(ANCHOR_TOKEN), F.lit(0))


def payload(c) -> Column:
    """Letters and digits in order, separators removed."""
    return F.regexp_replace(col(c), r"[^A-Za-z0-9]", "")


def has_numeric_field(c) -> Column:
    return col(c).rlike(NUMERIC_FIELD)


def has_identifier(c) -> Column:
    return col(c).rlike(IDENTIFIER)


def has_date(c) -> Column:
    return col(c).rlike(DATE)


def has_non_ascii(c) -> Column:
    return col(c).rlike(NON_ASCII)


def all_digits(c) -> Column:
    return col(c).rlike(r"^\p{IsDigit}+$")


def digits(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(DIGIT), F.lit(0))


def is_cosmetic(old, new) -> Column:
    """The edit changes nothing but white space."""
    return squeeze(old) == squeeze(new)


def classify(text, canonical) -> Column:
    """spacing, punctuation, case, or disagrees: how two spellings differ."""
    return F.arrow_udf(kinds, "string")(col(text), col(canonical))


def let(value, body) -> Column:
    """body(value), with the value's expression once in the plan however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def common_prefix(a, b) -> Column:
    """Number of leading characters that agree; linear in their length."""
    chars = lambda c: F.array_remove(F.split(col(c), ""), "")
    same = F.zip_with(chars(a), chars(b), lambda x, y: x.eqNullSafe(y))
    return (F.array_position(F.concat(same, F.array(F.lit(False))), F.lit(False)) - 1).cast("int")


def figure_safe(old, new) -> Column:
    """May a line with a figure be rewritten: the figure lies in what both agree on already."""
    shared = lambda s: F.struct(s["r"].alias("r"), common_prefix(s["l"], s["r"]).alias("n"))
    inside = lambda u: (u["n"] >= FIGURE_PREFIX) & ~u["r"].substr(u["n"] + 1, F.length(u["r"])).rlike(DIGIT)
    agreed = let(F.struct(strip(old).alias("l"), strip(new).alias("r")), lambda s: let(shared(s), inside))
    return F.when(has_numeric_field(old) | has_numeric_field(new), agreed).otherwise(True)


def anchored(a, b) -> Column:
    """Some run of three alphanumerics of one is part of such a run of the other."""
    left, right = anchors(strip(a)), anchors(strip(b))
    return F.exists(left, lambda g: F.exists(right, lambda c: F.contains(c, g) | F.contains(g, c)))


def core_of(pattern) -> Column:
    """From the first to the last alphanumeric, what lies between kept."""
    return F.regexp_extract(col(pattern), r"(?s)([A-Za-z0-9](?:.*[A-Za-z0-9])?)", 1)


def edit_budget(core) -> Column:
    return F.when(F.length(col(core)) <= SHORT_CORE, EDITS_SHORT).otherwise(EDITS_LONG)


def rule_id(page, text) -> Column:
    return F.concat(F.lit("p"), F.lpad(col(page).cast("string"), F.greatest(F.lit(4), F.length(col(page).cast("string"))), F.lit("0")), F.lit("-"), F.substring(F.sha1(col(text).cast("binary")), 1, 8))


def page_format(blob, formats=FORMATS) -> Column:
    """The format of a page from its lines joined by spaces; the first that matches counts."""
    out = F
    for key, pattern in formats:
        out = out.when(col(blob).rlike(pattern), key)
    return out.otherwise(UNKNOWN_FORMAT)


def resolve_dpi(native, requested) -> tuple[Column, Column, Column]:
    """(dpi, native, warning) from the scan's own and the requested resolution (null: automatic)."""
    native, requested = F.coalesce(col(native), F.lit(0)), col(requested)
    auto, known = requested.isNull(), native > 0
    dpi = F.when(auto & known, native).when(auto, FALLBACK_DPI).otherwise(requested)
    told = F.concat(F.lit("requested "), requested.cast("string"), F.lit(" dpi "))
    own = F.concat(F.lit("the scan's native "), native.cast("string"), F.lit(" dpi; "))
    warning = (
        F.when(auto & ~known, f"native resolution unknown; rendering at {FALLBACK_DPI} dpi")
        .when(~auto & known & (requested < native), F.concat(told, F.lit("is below "), own, F.lit("detail will be discarded")))
        .when(~auto & known & (requested > native), F.concat(told, F.lit("exceeds "), own, F.lit("this adds no detail")))
        .otherwise("")
    )
    return dpi.alias("dpi"), native.alias("native"), warning.alias("warning")


def two_places(conf) -> Column:
    """A confidence with two decimals, halves of the exact binary value to even."""
    return F.format_number(col(conf), 2)
