"""Declared error patterns, resolved against a controlled vocabulary.

Patterns and vocabulary are operator-written files, so they are driver-sized: the resolved
list becomes one array literal that a fold walks in file order over each line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemend.functions.text import core_of, cores, digits, edit_budget, word_tokens
from pagemend.schema import AMBIGUOUS, DIGITS_WOULD_CHANGE, NO_CANDIDATE, TOO_FAR

PATTERNS = "ord int, pattern string"


def patterns_table(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(patterns)), PATTERNS)


def known_tokens(terms: DataFrame) -> DataFrame:
    """(token): every alphabetic token of the terms, lower-cased."""
    return terms.select(F.explode(word_tokens("term")).alias("t")).select(F.lower("t").alias("token")).distinct()


def known_entries(terms: DataFrame) -> DataFrame:
    """(entry): every alphanumeric token of the terms in its first spelling."""
    flat = terms.select("ord", F.posexplode(cores("term")).alias("pos", "entry"))
    return flat.groupBy(F.lower("entry").alias("__low")).agg(F.min_by("entry", F.struct("ord", "pos")).alias("entry"), F.min(F.struct("ord", "pos")).alias("first")).select("entry", "first")


def malformed(patterns: DataFrame) -> DataFrame:
    """Patterns that don't name exactly one term."""
    core = core_of("pattern")
    return patterns.filter((core == "") | core.rlike(r"(?U)[\s\x1c-\x1f]"))


def contradictions(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Patterns declared wrong whose term the vocabulary (entry) declares right."""
    named = patterns.withColumn("__low", F.lower(core_of("pattern"))).filter("__low <> ''")
    return named.join(vocabulary.select(F.lower("entry").alias("__low")).distinct(), "__low", "left_semi").select(*patterns.columns)


def resolve(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(ord, pattern, core, rebuilt, reason): the one nearest term within the edit budget, or why there is none.

    Lengths within the budget are made equal keys; two nearest terms are no answer.
    """
    named = patterns.withColumn("core", core_of("pattern")).withColumn("budget", edit_budget("core"))
    n = F.length("core")
    asked = named.filter("core <> ''").withColumn("__n", F.explode(F.sequence(n - F.col("budget"), n + F.col("budget"))))
    pairs = asked.join(vocabulary.select("entry", F.length("entry").alias("__n")), "__n")
    scored = pairs.select("ord", F.struct(F.levenshtein(F.lower("core"), F.lower("entry")).alias("d"), F.col("entry").alias("e")).alias("s"))
    near = scored.groupBy("ord").agg(F.min("s.d").alias("best"), F.array_sort(F.collect_list("s")).alias("all"))
    near = near.withColumn("ties", F.transform(F.filter("all", lambda s: s["d"] == F.col("best")), lambda s: s["e"]))
    out = named.join(near, "ord", "left")
    start = F.instr("pattern", F.col("core")) - 1
    head, tail = F.substring("pattern", F.lit(1), start), F.col("pattern").substr(start + n + 1, F.length("pattern"))
    term = F.get("ties", F.lit(0))
    rebuilt = F.concat(head, term, tail)
    reason = (
        F.when((F.col("core") == "") | F.col("best").isNull(), NO_CANDIDATE)
        .when(F.col("best") > F.col("budget"), F.format_string(TOO_FAR, F.col("best"), F.col("budget")))
        .when(F.size("ties") > 1, F.format_string(AMBIGUOUS, F.array_join("ties", ", ")))
        .when(digits("pattern") != digits(rebuilt), DIGITS_WOULD_CHANGE)
    )
    return out.select("ord", "pattern", "core", F.when(reason.isNull(), rebuilt).alias("rebuilt"), F.coalesce(reason, F.lit("")).alias("reason"))


@dataclass(frozen=True)
class Resolved:
    """A pattern as regular expressions: where it is found, and what of it is replaced by what."""

    pattern: str
    found: str
    replaced: str
    term: str | None
    rebuilt: str | None
    reason: str


def compile_patterns(resolved: DataFrame) -> list[Resolved]:
    out = []
    for r in resolved.orderBy("ord").collect():  # an operator's file
        quoted = r"\Q" + r.pattern.replace(r"\E", r"\E\\E\Q") + r"\E"
        if r.core and r.core == r.pattern:  # a bare token must not lie inside a longer one
            found = r"(?U)(?<!\p{Alnum})" + quoted + r"(?!\p{Alnum})"
            out.append(Resolved(r.pattern, found, found, r.rebuilt, r.rebuilt, r.reason))
            continue
        at = r.pattern.index(r.core) if r.core else 0
        head, tail = r.pattern[:at], r.pattern[at + len(r.core) :]
        # delimiters are looked at, not taken, so that neighbours may share them
        inner = (rf"(?<=\Q{head}\E)" if head else "") + rf"\Q{r.core}\E" + (rf"(?=\Q{tail}\E)" if tail else "")
        term = r.rebuilt[len(head) : len(r.rebuilt) - len(tail)] if r.rebuilt is not None else None
        out.append(Resolved(r.pattern, quoted, inner, term, r.rebuilt, r.reason))
    return out


def apply_patterns(text, compiled: list[Resolved]) -> tuple[Column, Column]:
    """(new text, events): patterns one after the other, each on what the one before left.

    events: array of (pattern, detail, fixed), one for each pattern that was found.
    """
    event = "array<struct<pattern: string, detail: string, fixed: boolean>>"
    text = F.col(text) if isinstance(text, str) else text
    state = F.struct(text.alias("text"), F.array().cast(event).alias("events"))
    rules = F.array(*[F.struct(F.lit(c.pattern).alias("pattern"), F.lit(c.found).alias("found"), F.lit(c.replaced).alias("replaced"), F.lit(c.term).cast("string").alias("term"), F.lit(c.rebuilt if c.rebuilt is not None else c.reason).alias("detail")) for c in compiled])

    def step(acc, rule):
        hit = F.rlike(acc["text"], rule["found"])
        safe = F.regexp_replace(F.regexp_replace(rule["term"], F.lit(r"\\"), F.lit(r"\\\\")), F.lit(r"\$"), F.lit(r"\\\$"))
        new = F.when(hit & rule["term"].isNotNull(), F.regexp_replace(acc["text"], rule["replaced"], safe)).otherwise(acc["text"])
        told = F.when(hit, F.array(F.struct(rule["pattern"].alias("pattern"), rule["detail"].alias("detail"), rule["term"].isNotNull().alias("fixed")))).otherwise(F.array().cast(event))
        return F.struct(new.alias("text"), F.concat(acc["events"], told).alias("events"))

    done = F.aggregate(rules, state, step)
    return done["text"], done["events"]


def mentions(text, compiled: list[Resolved]) -> Column:
    """The text holds some pattern, at least as a substring."""
    text = F.col(text) if isinstance(text, str) else text
    out = F.lit(False)
    for c in compiled:
        out = out | F.contains(text, F.lit(c.pattern))
    return out
