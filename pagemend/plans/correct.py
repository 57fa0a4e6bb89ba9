"""The whole correction of many documents at once, as one chain of columns.

Everything that is voted on comes from raw lines, so the evidence is computed up front. Only
lines that can change or need a word (low confidence, non-ASCII, a declared pattern, a
typographic twin) enter the chain; the others, nearly all, are never shuffled. Their pages
meet the edits once, at the end, as a map from line number to text. Evidence and the chain's
steps are cut to the shared folder: six result tables read them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemend.functions.text import has_non_ascii
from pagemend.operators import canon, disagree, errors, fold, lexical, lexicon, recover
from pagemend.operators.cluster import CLUSTER, cluster_info, cluster_pages
from pagemend.schema import CONF_GATE, DISAGREE_RATIO, MIN_CLEAN_SIBLINGS, NO_CANONICAL, NO_SUPPORT, lines_of

from .cut import cut

LINE_KEY = ["document_id", "page_ord", "line_no"]
TYPOGRAPHIC = ("spacing", "punctuation", "case")
CHAIN = [*LINE_KEY, "cluster_key", "page_number", "n_lines", "text", "conf"]


@dataclass
class Correction:
    """pages: the input's, with ``cluster_key`` and ``corrected`` (texts, one a line). The rest are tables of rows."""

    pages: DataFrame
    changes: DataFrame
    clusters: DataFrame
    uncorrected: DataFrame
    disagreements: DataFrame
    unresolved_non_ascii: DataFrame
    protected: DataFrame
    error_events: DataFrame

    @property
    def lines(self) -> DataFrame:
        """One row a line with its corrected text; as many rows as the input has lines."""
        zipped = F.arrays_zip("lines", "corrected")
        flat = self.pages.select("document_id", "page_ord", "page_number", "cluster_key", F.posexplode(zipped).alias("line_no", "z"))
        return flat.select("document_id", "page_ord", "page_number", "cluster_key", "line_no", "z.lines.text", "z.lines.conf", "z.lines.box", "z.corrected")


def edited(pages: DataFrame, edits: DataFrame, base) -> DataFrame:
    """pages with ``corrected``: base(line, number) unless edits (document_id, page_ord, line_no, new) have the line."""
    maps = edits.groupBy("document_id", "page_ord").agg(F.map_from_entries(F.collect_list(F.struct("line_no", "new"))).alias("__edits"))
    joined = pages.join(maps, ["document_id", "page_ord"], "left")
    new = F.transform("lines", lambda x, i: F.coalesce(F.try_element_at(F.col("__edits"), i), base(x, i)))
    return joined.withColumn("corrected", new).drop("__edits")


def correct(
    pages: DataFrame,
    conf_gate: float = CONF_GATE,
    profile=None,
    ascii_mode: str = fold.EVIDENCE,
    plausible=None,
    disagree_ratio: float = DISAGREE_RATIO,
    known: DataFrame | list[str] | None = None,
    error_patterns: list[errors.Resolved] = (),
    typography: bool = True,
    formats=None,
) -> Correction:
    """Repair low-confidence lines, fold, apply declared patterns, adopt typography; report the rest.

    profile: ``review.Profile``; known: lower-cased alphabetic tokens (a list, or a table of
    token); plausible: ``lexical.Plausibility`` or a function of a column; error_patterns: what
    ``errors.compile_patterns`` gives. A null text or confidence counts as empty and 0.
    """
    clean = F.transform("lines", lambda x: F.struct(F.coalesce(x["text"], F.lit("")).alias("text"), F.coalesce(x["conf"], F.lit(0.0)).alias("conf"), x["box"].alias("box")))
    clustered = cluster_pages(pages.withColumn("lines", clean), *([formats] if formats else []))
    slots_p, lines_p = (profile.slots, profile.lines) if profile is not None else (None, None)
    clusters = cluster_info(clustered, profile.clusters if profile is not None else None)
    lines = lines_of(clustered).select(*CHAIN)

    known = lexical.token_table(pages.sparkSession, known)

    # evidence
    counts = cut(canon.text_counts(clustered, conf_gate))
    slots, index = canon.slot_canon(clustered, plausible), canon.line_index(counts)
    if profile is not None:
        slots, index = canon.assert_slots(slots, clusters, slots_p), canon.assert_lines(index, clusters, lines_p)
    words = cut(lexicon.build_lexicon(clustered))
    canonical = disagree.canonical_counts(counts, clusters, lines_p)
    contradicted = disagree.disagreeing_texts(counts, canonical, disagree_ratio)
    found = cut(lines.filter(F.col("conf") >= conf_gate).join(contradicted, [*CLUSTER, "text"]))

    # low-confidence lines: boilerplate, then lexicon
    low = cut(lines.filter(F.col("conf") < conf_gate).join(clusters.select(*CLUSTER, "can_vote"), CLUSTER))
    placed = recover.recover(low.filter("can_vote"), slots, index, known)
    nothing = [F.lit(None).cast("string").alias(c) for c in ("boilerplate", "guard", "refused")]
    placed = placed.unionByName(low.filter("not can_vote").select(*low.columns, *nothing))
    # repaired whether or not a canonical is found, which outranks it: neither step waits for the other
    repaired = lexicon.repair(low.select(*LINE_KEY, "text"), words, known).withColumnRenamed("guard", "lex_guard")
    both = placed.join(repaired, LINE_KEY, "left")
    mine = [F.when(F.col("boilerplate").isNull(), F.col(c)).alias(c) for c in ("repaired", "lex_guard", "naive", "vouched")]
    low2 = both.select(*placed.columns, *mine)

    # confident lines that later stages may touch
    special = has_non_ascii("text") | errors.mentions("text", error_patterns) if error_patterns else has_non_ascii("text")
    high = lines.filter((F.col("conf") >= conf_gate) & special)
    if typography:
        high = high.unionByName(found.filter(F.col("kind").isin(*TYPOGRAPHIC) & ~special).select(*CHAIN))
    work = low2.unionByName(high, allowMissingColumns=True).withColumn("s2", F.coalesce("boilerplate", "repaired", "text"))
    work = work.withColumn("fixed2", F.coalesce("boilerplate", "repaired").isNotNull())

    # plain spellings
    if ascii_mode == fold.OFF:
        work = work.withColumn("ascii", F.lit(None).cast("string")).withColumn("unresolved", F.lit(False))
    else:
        work = fold.with_plain(work, counts, "s2", ascii_mode)
        work = work.withColumn("ascii", F.when(F.col("plain") != F.col("s2"), F.col("plain")))
        rare = (F.col("plain") == F.col("s2")) & (F.col("own") < MIN_CLEAN_SIBLINGS) if ascii_mode == fold.EVIDENCE else F.lit(False)
        work = work.withColumn("unresolved", F.coalesce(rare, F.lit(False)))
    work = work.withColumn("s3", F.coalesce("ascii", "s2"))

    # declared patterns
    if error_patterns:
        new, events = errors.apply_patterns("s3", error_patterns)
        work = work.withColumn("__p", F.struct(new.alias("text"), events.alias("events")))
        work = work.withColumn("s4", F.col("__p.text")).withColumn("events", F.col("__p.events")).drop("__p")
    else:
        work = work.withColumn("s4", F.col("s3")).withColumn("events", F.array().cast("array<struct<pattern: string, detail: string, fixed: boolean>>"))
    work = work.withColumn("errorfix", F.when(F.col("s4") != F.col("s3"), F.col("s4")))
    work = work.withColumn("fixed4", F.col("fixed2") | F.col("ascii").isNotNull() | F.col("errorfix").isNotNull())

    # typography of lines that nothing else has changed
    if typography:
        adopted = found.filter(F.col("kind").isin(*TYPOGRAPHIC)).select("document_id", "page_ord", "text", F.col("canonical").alias("__typ")).distinct()
        work = work.join(adopted, ["document_id", "page_ord", "text"], "left")
        work = work.withColumn("typography", F.when(~F.col("fixed4") & (F.col("__typ") != F.col("s4")), F.col("__typ")))
    else:
        work = work.withColumn("typography", F.lit(None).cast("string"))
    work = cut(work.withColumn("final", F.coalesce("typography", "s4")).withColumn("fixed", F.col("fixed4") | F.col("typography").isNotNull()))

    at = ["document_id", "page_ord", "page_number", "line_no"]
    kinds = (("boilerplate", "boilerplate"), ("lexicon", "repaired"), ("ascii", "ascii"), ("errorfix", "errorfix"), ("typography", "typography"))
    rows = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("seq"), F.lit(k).alias("kind"), F.col("text").alias("old"), F.col(c).alias("new"))) for i, (k, c) in enumerate(kinds, 1)]))
    changes = work.select(*at, F.explode(rows).alias("c")).select(*at, "c.*")
    guards = F.array_compact(F.array(
        F.when(F.col("guard").isNotNull(), F.struct(F.col("guard").alias("guard"), F.col("text").alias("before"), F.col("refused").alias("after"))),
        F.when(F.col("lex_guard").isNotNull(), F.struct(F.col("lex_guard").alias("guard"), F.col("text").alias("before"), F.col("naive").alias("after"))),
    ))
    tokens = F.transform(F.coalesce("vouched", F.array().cast("array<struct<tok_no: int, token: string, best: string>>")), lambda v: F.struct(F.lit("known").alias("guard"), v["token"].alias("before"), v["best"].alias("after")))
    protected = work.select(*at, F.explode(F.concat(guards, tokens)).alias("p")).select(*at, "p.*")
    reason = F.when(F.col("can_vote"), NO_CANONICAL).otherwise(NO_SUPPORT)
    changed = changes.select("document_id", "page_number", F.col("old").alias("text")).distinct()
    edits = work.filter("final <> text").select(*LINE_KEY, F.col("final").alias("new"))
    return Correction(
        pages=edited(clustered, edits, lambda x, i: x["text"]),
        changes=changes,
        clusters=clusters,
        uncorrected=work.filter((F.col("conf") < conf_gate) & ~F.col("fixed")).select(*at, "conf", "text", reason.alias("reason")),
        disagreements=found.join(changed, ["document_id", "page_number", "text"], "left_anti").select(*at, "conf", "text", "canonical", "kind"),
        unresolved_non_ascii=work.filter("unresolved").select(*at, "conf", F.col("s2").alias("text")),
        protected=protected,
        error_events=work.select(*at, "conf", F.col("s3").alias("text"), F.explode("events").alias("e")).filter("not e.fixed").select(*at, "conf", "text", "e.pattern", "e.detail"),
    )
