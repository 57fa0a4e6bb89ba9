"""Driver queries over ``documents`` read as recognized pages, and the same in SQL.

A source is a document, a row is a page, its language the format cluster; every 23rd line or
so is garbled and scored low. Everything runs over whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemend.functions import text as T
from pagemend.operators import canon, disagree, errors, fold, lexical, lexicon, recover, review
from pagemend.operators.cluster import CLUSTER, cluster_info, cluster_pages
from pagemend.plans.correct import Correction, correct
from pagemend.plans.cut import cut
from pagemend.ratio_sql import bag_bound, can_share, mask, ratio_parts
from pagemend.schema import CONF_GATE, LINE, MIN_CLEAN_SIBLINGS, MIN_LINE_LENGTH, lines_of
from pagemend.sinks import text as sink
from pagemend.sources import cached, container, rules, terms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as pages: one projection, no shuffle."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")

    def line(raw, p):
        i = (p + 1).cast("long")
        bad = (F.col("doc_id") * 31 + i * 17) % 23 == 0
        text = F.when(bad, F.replace(F.replace(raw, F.lit("o"), F.lit("0")), F.lit("l"), F.lit("1"))).otherwise(raw)
        conf = F.when(bad, 60 + (F.col("doc_id") + i) % 25).otherwise(95 + (F.col("doc_id") + i) % 5).cast("double") / F.lit(100.0)
        return F.struct(text.alias("text"), conf.alias("conf"), F.lit(None).alias("box")).cast(LINE)

    lines = F.filter(F.transform(F.split("text", "\n"), line), lambda x: F.length(x["text"]) > 0)
    return docs.select(
        F.coalesce("source", F.lit("?")).alias("document_id"), F.col("doc_id").alias("page_ord"), F.col("doc_id").alias("page_number"),
        F.coalesce(lines, F.array().cast(f"array<{LINE}>")).alias("lines"), F.coalesce("lang", F.lit("?")).alias("cluster_key"),
    )


LINES_SQL = r"""
raw AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), noisy AS (
  SELECT coalesce(source, '?') AS document_id, coalesce(lang, '?') AS cluster_key, doc_id AS page, i,
         CASE WHEN (doc_id * 31 + i * 17) % 23 = 0 THEN replace(replace(raw, 'o', '0'), 'l', '1') ELSE raw END AS text,
         CAST(CASE WHEN (doc_id * 31 + i * 17) % 23 = 0 THEN 60 + (doc_id + i) % 25 ELSE 95 + (doc_id + i) % 5 END AS DOUBLE) / CAST(100 AS DOUBLE) AS conf
  FROM raw WHERE length(raw) > 0
), lines AS (
  SELECT document_id, cluster_key, page, text, conf, row_number() OVER (PARTITION BY page ORDER BY i) - 1 AS line_no, count(*) OVER (PARTITION BY page) AS n_lines FROM noisy
)"""
NUMERIC_SQL = r"""'\$[\s\x1c-\x1f]?\d|\d[\d,]*\.\d{2}\b|\bNo[:.]?[\s\x1c-\x1f]*\d'"""
STRIP = r"regexp_replace({0}, '^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$', '', 'g')"
PREFIX = "len(list_filter(range(1, least(length({0}), length({1})) + 1), lambda i: left({0}, i) = left({1}, i)))"
TALLY_SQL = rf"""
tally AS (
  SELECT document_id, cluster_key, side, k, text, count(*) AS n FROM (
    SELECT document_id, cluster_key, 'top' AS side, line_no AS k, text, conf FROM lines
    UNION ALL SELECT document_id, cluster_key, 'bottom', n_lines - 1 - line_no, text, conf FROM lines)
  WHERE k < 4 AND conf >= 0.95 AND NOT regexp_matches(text, {NUMERIC_SQL}) GROUP BY ALL
)"""
SLOTS_SQL = TALLY_SQL + r""", slots AS (
  SELECT document_id, cluster_key, side, k, text, n AS support FROM tally
  QUALIFY row_number() OVER (PARTITION BY document_id, cluster_key, side, k ORDER BY n DESC, text) = 1
)"""
STANDING_SQL = r"""
standing AS (
  SELECT document_id, cluster_key, text, count(*) AS support FROM lines WHERE conf >= 0.95 AND length(text) >= 18 GROUP BY ALL HAVING count(*) >= 3
)"""


#: Texts of each cluster as ``canon.text_counts`` counts them, and what ``disagree.canonical_counts`` takes for canonical.
COUNTS_SQL = rf"""
sized AS (
  SELECT coalesce(source, '?') AS document_id, coalesce(lang, '?') AS cluster_key, count(*) AS n_pages, greatest(3, floor(count(*) / 4.0)) AS least FROM documents GROUP BY ALL
), counts AS (
  SELECT document_id, cluster_key, text, {STRIP.format('text')} AS s, count(*) AS n, count(*) FILTER (conf >= 0.95) AS n_clean, count(*) FILTER (conf >= 0.9) AS n_confident, min((page, line_no)) AS first FROM lines GROUP BY ALL
), canonical AS (
  SELECT c.* FROM counts c JOIN sized z USING (document_id, cluster_key) WHERE c.n >= z.least AND length(c.text) >= 8
)"""
#: Standing lines without near misses: what is left of the tally once far more frequent near-twins have spoken.
_TWIN = "abs(length(t.text) - length(f.text)) <= 3 AND f.n > t.n AND t.n <= greatest(1, floor(f.n * 0.25))"
INDEX_SQL = rf"""
std AS (
  SELECT document_id, cluster_key, text, n_clean AS n FROM counts WHERE n_clean >= 3 AND length(text) >= 18
), twins AS (
  SELECT DISTINCT t.text AS a, f.text AS b FROM std t JOIN std f USING (document_id, cluster_key) WHERE {_TWIN} AND {bag_bound('t.text', 'f.text')} * 2 >= 0.9::DOUBLE * (length(t.text) + length(f.text))
), {ratio_parts("twins", "twin_ratios")}, line_index AS (
  SELECT document_id, cluster_key, text, n AS support FROM std t
  WHERE NOT EXISTS (SELECT 1 FROM std f JOIN twin_ratios r ON r.b = f.text WHERE f.document_id = t.document_id AND f.cluster_key = t.cluster_key AND r.a = t.text AND {_TWIN} AND r.r >= 0.9::DOUBLE)
)"""


def _figures_kept(old: str, new: str, s_old: str, s_new: str) -> str:
    n = PREFIX.format(s_old, s_new)
    return f"((NOT regexp_matches({old}, {NUMERIC_SQL}) AND NOT regexp_matches({new}, {NUMERIC_SQL})) OR ({n} >= 20 AND NOT regexp_matches({s_new}[{n} + 1:], '\\d')))"


#: Each distinct confident text with its nearest canonical, by the ratio or else by its opening.
DISAGREE_SQL = rf"""
probe AS (
  SELECT * FROM counts c WHERE n_confident > 0 AND length(text) >= 8 AND NOT regexp_matches(text, '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b')
    AND NOT EXISTS (SELECT 1 FROM canonical k WHERE k.document_id = c.document_id AND k.cluster_key = c.cluster_key AND k.text = c.text)
), judges AS (
  SELECT p.document_id, p.cluster_key, p.text, p.s, k.text AS other, k.s AS ks, k.first
  FROM probe p JOIN canonical k USING (document_id, cluster_key)
  WHERE p.n <= greatest(1, floor(k.n * 0.25)) AND NOT regexp_matches(k.text, '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b')
    AND (abs(length(p.text) - length(k.text)) <= 3 OR (length(p.s) >= 20 AND left(p.s, 20) = left(k.s, 20)))
), alike AS (
  SELECT DISTINCT text AS a, other AS b FROM judges WHERE abs(length(text) - length(other)) <= 3 AND {bag_bound('text', 'other')} * 2 >= 0.9::DOUBLE * (length(text) + length(other))
), {ratio_parts("alike", "alike_ratios")}, whole AS (
  SELECT document_id, cluster_key, text, other AS canonical FROM judges j JOIN alike_ratios r ON r.a = j.text AND r.b = j.other
  WHERE r.r > 0.9::DOUBLE AND {_figures_kept('j.text', 'j.other', 'j.s', 'j.ks')}
  QUALIFY row_number() OVER (PARTITION BY document_id, cluster_key, text ORDER BY r.r DESC, first) = 1
), opened AS (
  SELECT *, {PREFIX.format('s', 'ks')} AS shared FROM judges j
  WHERE length(s) >= 20 AND length(ks) >= 20 AND left(s, 20) = left(ks, 20) AND s <> ks AND NOT EXISTS (SELECT 1 FROM whole w WHERE w.document_id = j.document_id AND w.cluster_key = j.cluster_key AND w.text = j.text)
), by_opening AS (
  SELECT document_id, cluster_key, text, other AS canonical FROM opened WHERE shared >= 0.4::DOUBLE * length(ks) AND {_figures_kept('text', 'other', 's', 'ks')}
  QUALIFY row_number() OVER (PARTITION BY document_id, cluster_key, text ORDER BY shared DESC, first) = 1
), contradicted AS (
  SELECT *, {{classify}} AS kind FROM (SELECT * FROM whole UNION ALL SELECT * FROM by_opening)
)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts)


@query(with_(LINES_SQL) + r"""
SELECT page, line_no, len(regexp_extract_all(text, '[^\s\x1c-\x1f]+'))::BIGINT AS n_tokens, len(regexp_extract_all(text, '[A-Za-z]{3,}'))::BIGINT AS n_words,
       len(regexp_extract_all(text, '[A-Za-z0-9]{3,}'))::BIGINT AS n_anchors, len(regexp_extract_all(text, '[A-Za-z0-9]+'))::BIGINT AS n_cores
FROM lines""")
def tokenize(spark, sf_dir):
    n = {"n_tokens": T.tokens, "n_words": T.word_tokens, "n_anchors": T.anchors, "n_cores": T.cores}
    return lines_of(ocr_pages(spark, sf_dir)).select(F.col("page_ord").alias("page"), "line_no", *[F.size(f("text")).cast("long").alias(k) for k, f in n.items()])


@query(with_(LINES_SQL) + rf"""
SELECT page, line_no, regexp_matches(text, {NUMERIC_SQL}) AS is_numeric, regexp_matches(text, '\d{{5,}}') AS is_identifier,
       regexp_matches(text, '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b') AS is_date, regexp_matches(text, '[^\x00-\x7F]') AS is_non_ascii FROM lines""")
def text_shapes(spark, sf_dir):
    f = {"is_numeric": T.has_numeric_field, "is_identifier": T.has_identifier, "is_date": T.has_date, "is_non_ascii": T.has_non_ascii}
    return lines_of(ocr_pages(spark, sf_dir)).select(F.col("page_ord").alias("page"), "line_no", *[g("text").alias(k) for k, g in f.items()])


@query(with_(LINES_SQL) + r"""
SELECT page, line_no, md5(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS payload_md5, md5(regexp_extract(text, '(?s)([A-Za-z0-9](?:.*[A-Za-z0-9])?)', 1)) AS core_md5 FROM lines""")
def payload(spark, sf_dir):
    return lines_of(ocr_pages(spark, sf_dir)).select(F.col("page_ord").alias("page"), "line_no", F.md5(T.payload("text").cast("binary")).alias("payload_md5"), F.md5(T.core_of("text").cast("binary")).alias("core_md5"))


_SQUEEZED = r"regexp_replace({0}, '[\s\x1c-\x1f]+', '', 'g')"
_PAYLOAD = r"regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')"


def _classify_sql(a: str, b: str) -> str:
    return (
        f"CASE WHEN {_SQUEEZED.format(a)} = {_SQUEEZED.format(b)} THEN 'spacing' WHEN {_PAYLOAD.format(a)} = {_PAYLOAD.format(b)} THEN 'punctuation' "
        f"WHEN lower({_PAYLOAD.format(a)}) = lower({_PAYLOAD.format(b)}) THEN 'case' ELSE 'disagrees' END"
    )


def _disagree_sql() -> str:
    return DISAGREE_SQL.replace("{classify}", _classify_sql("text", "canonical"))


@query(with_(LINES_SQL) + f"""
SELECT page, line_no, {_classify_sql("text", "replace(text, ' ', '')")} AS k1, {_classify_sql("text", "text || '.'")} AS k2,
       {_classify_sql("text", "translate(text, 'AEIOU', 'aeiou')")} AS k3, {_classify_sql("text", "replace(text, 'e', 'a')")} AS k4 FROM lines""")
def classify_pairs(spark, sf_dir):
    other = [F.replace("text", F.lit(" "), F.lit("")), F.concat("text", F.lit(".")), F.translate("text", "AEIOU", "aeiou"), F.replace("text", F.lit("e"), F.lit("a"))]
    return lines_of(ocr_pages(spark, sf_dir)).select(F.col("page_ord").alias("page"), "line_no", *[T.classify("text", o).alias(f"k{i}") for i, o in enumerate(other, 1)])


@query(with_(LINES_SQL) + r"""
SELECT page, line_no, 'p' || lpad(page::VARCHAR, greatest(4, length(page::VARCHAR))::INT, '0') || '-' || left(sha1(text), 8) AS rule_id FROM lines WHERE conf < 0.9""")
def rule_ids(spark, sf_dir):
    return lines_of(ocr_pages(spark, sf_dir)).filter(F.col("conf") < CONF_GATE).select(F.col("page_ord").alias("page"), "line_no", T.rule_id("page_ord", "text").alias("rule_id"))


@query(r"""
WITH asked AS (SELECT doc_id AS page, (doc_id % 4 * 100)::INT AS own, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE (doc_id % 5 * 100 + 100)::INT END AS requested FROM documents)
SELECT page, CASE WHEN requested IS NULL THEN CASE WHEN own > 0 THEN own ELSE 300 END ELSE requested END AS dpi, own AS native,
  CASE WHEN requested IS NULL AND own = 0 THEN 'native resolution unknown; rendering at 300 dpi'
       WHEN own > 0 AND requested < own THEN 'requested ' || requested || ' dpi is below the scan''s native ' || own || ' dpi; detail will be discarded'
       WHEN own > 0 AND requested > own THEN 'requested ' || requested || ' dpi exceeds the scan''s native ' || own || ' dpi; this adds no detail' ELSE '' END AS warning
FROM asked""")
def resolve_dpi(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page"))
    own, requested = (F.col("page") % 4 * 100).cast("int"), F.when(F.col("page") % 3 != 0, (F.col("page") % 5 * 100 + 100).cast("int"))
    return docs.select("page", *T.resolve_dpi(own, requested))


_FORMATS = (("B", "Lizenz|licen[cs]e"), ("A", "the |der "))
_CLUSTERS_SQL = with_(LINES_SQL) + r""", formats AS (
  SELECT coalesce(d.source, '?') AS document_id, d.doc_id AS page, coalesce(b.blob, '') AS blob
  FROM documents d LEFT JOIN (SELECT page, string_agg(text, ' ' ORDER BY line_no) AS blob FROM lines GROUP BY page) b ON b.page = d.doc_id
), keyed AS (
  SELECT document_id, page, CASE WHEN regexp_matches(blob, 'Lizenz|licen[cs]e') THEN 'B' WHEN regexp_matches(blob, 'the |der ') THEN 'A' ELSE '?' END AS cluster_key FROM formats
)"""


@query(_CLUSTERS_SQL + " SELECT document_id, page, cluster_key FROM keyed")
def clusters(spark, sf_dir):
    pages = cluster_pages(ocr_pages(spark, sf_dir).drop("cluster_key"), _FORMATS)
    return pages.select("document_id", F.col("page_ord").alias("page"), "cluster_key")


@query(_CLUSTERS_SQL + " SELECT document_id, cluster_key, count(*)::BIGINT AS n_pages, count(*) >= 4 AS can_vote FROM keyed GROUP BY ALL")
def can_vote(spark, sf_dir):
    return cluster_info(cluster_pages(ocr_pages(spark, sf_dir).drop("cluster_key"), _FORMATS))


@query(with_(LINES_SQL, SLOTS_SQL) + " SELECT document_id, cluster_key, side, k, text, support FROM slots")
def slot_canon(spark, sf_dir):
    return canon.slot_canon(ocr_pages(spark, sf_dir))


@query(with_(LINES_SQL, STANDING_SQL) + " SELECT document_id, cluster_key, text, support FROM standing")
def standing_lines(spark, sf_dir):
    return _standing(canon.text_counts(ocr_pages(spark, sf_dir))).select(*CLUSTER, "text", "support")


def _standing(counts: DataFrame) -> DataFrame:
    tally = counts.filter((F.col("n_clean") >= MIN_CLEAN_SIBLINGS) & (F.length("text") >= MIN_LINE_LENGTH))
    order = F.struct(F.lit(0).alias("asserted"), (-F.col("n_clean")).alias("by"), F.col("text").alias("t"))
    return tally.select(*CLUSTER, "text", F.col("n_clean").alias("support"), order.alias("ord"))


_WORDS = ["the", "and", "die", "der", "les", "des", "que", "los", "page", "note"]
_ZIPF = {"the": 7.0, "that": 6.0, "with": 5.9, "for": 6.1, "con": 1.4, "nicht": 1.5, "dans": 1.6, "para": 1.2, "una": 1.49}
_COMMON_SQL = ", ".join(f"'{w}'" for w, z in _ZIPF.items() if z >= 1.5 and w not in _WORDS)
_WORDS_SQL = ", ".join(f"'{w}'" for w in _WORDS)


@query(with_(LINES_SQL, TALLY_SQL) + rf""", close AS (
  SELECT *, regexp_extract_all(text, '[A-Za-z]{{3,}}') AS w FROM tally QUALIFY n * 1.5::DOUBLE >= max(n) OVER (PARTITION BY document_id, cluster_key, side, k)
), scored AS (
  SELECT *, CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE (len(list_filter(w, lambda x: lower(x) IN ({_WORDS_SQL})))::DOUBLE + 0.6::DOUBLE * len(list_filter(w, lambda x: lower(x) IN ({_COMMON_SQL})))::DOUBLE) / len(w)::DOUBLE END AS p FROM close
)
SELECT document_id, cluster_key, side, k, text, n AS support FROM scored QUALIFY row_number() OVER (PARTITION BY document_id, cluster_key, side, k ORDER BY p DESC, n DESC, text DESC) = 1""")
def modal_tiebreak(spark, sf_dir):
    known = spark.createDataFrame([(w,) for w in _WORDS], "token string")
    zipf = spark.createDataFrame([(w, z) for w, z in _ZIPF.items()], "token string, zipf double")
    return canon.choose(canon.slot_tally(ocr_pages(spark, sf_dir)), canon.SLOT, lexical.Plausibility(known, lexical.table_frequencies(zipf)))


def _low(pages: DataFrame) -> DataFrame:
    return lines_of(pages).filter(F.col("conf") < CONF_GATE)


@query(with_(LINES_SQL, STANDING_SQL) + rf""", low AS (
  SELECT DISTINCT document_id, cluster_key, text, {STRIP.format('text')} AS s FROM lines WHERE conf < 0.9
), idx AS (SELECT *, {STRIP.format('text')} AS s FROM standing), near AS (
  SELECT l.document_id, l.cluster_key, l.text, i.text AS other, i.support, {PREFIX.format('l.s', 'i.s')} AS n
  FROM low l JOIN idx i ON l.document_id = i.document_id AND l.cluster_key = i.cluster_key AND left(l.s, 12) = left(i.s, 12)
  WHERE length(l.s) >= 12 AND length(i.s) >= 12 AND l.text <> i.text
)
SELECT document_id, cluster_key, text, other AS prefix_text FROM near QUALIFY row_number() OVER (PARTITION BY document_id, cluster_key, text ORDER BY n DESC, support DESC, other) = 1""")
def prefix_recovery(spark, sf_dir):
    pages = ocr_pages(spark, sf_dir)
    return recover.prefix_candidates(_low(pages), _standing(canon.text_counts(pages)))


@query(with_(LINES_SQL, SLOTS_SQL) + rf""", pairs AS (
  SELECT l.document_id, l.page, l.line_no, s.text AS slot_text, s.support, regexp_extract_all({STRIP.format('l.text')}, '[A-Za-z0-9]{{3,}}') AS a, regexp_extract_all({STRIP.format('s.text')}, '[A-Za-z0-9]{{3,}}') AS b
  FROM lines l JOIN slots s ON l.document_id = s.document_id AND l.cluster_key = s.cluster_key AND s.support >= 3 AND s.text <> l.text
    AND ((s.side = 'top' AND s.k = l.line_no) OR (s.side = 'bottom' AND s.k = l.n_lines - 1 - l.line_no))
  WHERE l.conf < 0.9
), good AS (
  SELECT * FROM pairs WHERE len(list_filter(a, lambda g: len(list_filter(b, lambda c: contains(c, g) OR contains(g, c))) > 0)) > 0
), best AS (
  SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY page, line_no ORDER BY support DESC, slot_text DESC) = 1
)
SELECT l.page, l.line_no, b.slot_text FROM lines l LEFT JOIN best b ON l.page = b.page AND l.line_no = b.line_no WHERE l.conf < 0.9""")
def slot_recovery_anchor(spark, sf_dir):
    pages = ocr_pages(spark, sf_dir)
    out = recover.slot_candidates(_low(pages), canon.slot_canon(pages), least_ratio=None)
    return out.select(F.col("page_ord").alias("page"), "line_no", "slot_text")


@query(with_(LINES_SQL) + rf""", pairs AS (
  SELECT page, line_no, {STRIP.format('text')} AS a, {STRIP.format("regexp_replace(text, '[0-9]', '7')")} AS b, regexp_matches(text, {NUMERIC_SQL}) AS fa,
         regexp_matches(regexp_replace(text, '[0-9]', '7'), {NUMERIC_SQL}) AS fb
  FROM lines WHERE regexp_matches(text, '[0-9]')
), shared AS (SELECT *, {PREFIX.format('a', 'b')} AS n FROM pairs)
SELECT page, line_no, (NOT fa AND NOT fb) OR (n >= 20 AND NOT regexp_matches(b[n + 1:], '\d')) AS is_safe FROM shared""")
def figure_guard(spark, sf_dir):
    with_digit = lines_of(ocr_pages(spark, sf_dir)).filter(F.col("text").rlike("[0-9]"))
    changed = F.expr("concat(substr(text, 1, regexp_instr(text, '[0-9]') - 1), '7', substr(text, regexp_instr(text, '[0-9]') + 1))")
    return with_digit.select(F.col("page_ord").alias("page"), "line_no", T.figure_safe("text", changed).alias("is_safe"))


_LEXICON_SQL = r"""
toks AS (
  SELECT document_id, conf, t AS token FROM (SELECT document_id, conf, unnest(regexp_extract_all(text, '[^\s\x1c-\x1f]+')) AS t FROM lines) WHERE length(t) >= 3 AND NOT regexp_matches(t, '^\p{Nd}+$')
), lexicon AS (SELECT document_id, token, count(*) AS freq FROM toks WHERE conf >= 0.95 GROUP BY ALL)"""


#: The nearest attested token of each token in a low-confidence line, and these lines repaired.
REPAIR_SQL = rf"""
first_read AS (
  SELECT document_id, token, min((page, line_no, tok_no)) AS first, {mask('token')} AS bits FROM (
    SELECT document_id, page, line_no, unnest(regexp_extract_all(text, '[^\s\x1c-\x1f]+')) AS token, generate_subscripts(regexp_extract_all(text, '[^\s\x1c-\x1f]+'), 1) AS tok_no FROM lines WHERE conf >= 0.95)
  WHERE length(token) >= 3 AND NOT regexp_matches(token, '^\p{{Nd}}+$') GROUP BY document_id, token
), low_tokens AS (
  SELECT document_id, page, line_no, unnest(regexp_extract_all(text, '[^\s\x1c-\x1f]+')) AS token, generate_subscripts(regexp_extract_all(text, '[^\s\x1c-\x1f]+'), 1) AS tok_no FROM {{low}}
), strange AS (
  SELECT document_id, token, {mask('token')} AS bits FROM (SELECT DISTINCT document_id, token FROM low_tokens t WHERE length(token) >= 3 AND NOT regexp_matches(token, '^\p{{Nd}}+$')
    AND NOT EXISTS (SELECT 1 FROM first_read f WHERE f.document_id = t.document_id AND f.token = t.token))
), near AS (
  SELECT s.document_id, s.token, f.token AS other, f.first FROM strange s JOIN first_read f ON f.document_id = s.document_id AND length(f.token) BETWEEN length(s.token) - 2 AND length(s.token) + 2
  WHERE {can_share('s.token', 'f.token', 's.bits', 'f.bits')} * 2 >= 0.72::DOUBLE * (length(s.token) + length(f.token))
), words AS (
  SELECT DISTINCT token AS a, other AS b FROM near WHERE {bag_bound('token', 'other')} * 2 >= 0.72::DOUBLE * (length(token) + length(other))
), {ratio_parts("words", "word_ratios")}, nearest AS (
  SELECT document_id, token, other AS best FROM near JOIN word_ratios r ON r.a = near.token AND r.b = near.other WHERE r.r >= 0.72::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY document_id, token ORDER BY r.r DESC, first) = 1
), rebuilt AS (
  SELECT document_id, page, line_no, string_agg(coalesce(best, token), ' ' ORDER BY tok_no) AS free FROM low_tokens LEFT JOIN nearest USING (document_id, token) GROUP BY ALL
), told AS (
  SELECT l.document_id, l.page, l.line_no, l.text, coalesce(free, '') AS free,
         CASE WHEN regexp_matches(l.text, {NUMERIC_SQL}) THEN 'numeric' WHEN regexp_matches(l.text, '\d{{5,}}') THEN 'identifier' END AS held
  FROM {{low}} l LEFT JOIN rebuilt r USING (document_id, page, line_no)
), repairs AS (
  SELECT document_id, page, line_no, CASE WHEN held IS NULL AND free <> text AND {_SQUEEZED.format('free')} <> {_SQUEEZED.format('text')} THEN free END AS repaired,
         CASE WHEN held IS NOT NULL AND free <> text THEN held END AS guard, CASE WHEN held IS NOT NULL AND free <> text THEN free END AS naive FROM told
)"""


@query(with_(LINES_SQL, _LEXICON_SQL) + " SELECT document_id, token, freq FROM lexicon")
def lexicon_counts(spark, sf_dir):
    return lexicon.build_lexicon(ocr_pages(spark, sf_dir)).select("document_id", "token", "freq")


@query(with_(LINES_SQL, _LEXICON_SQL) + r"""
SELECT document_id, token, count(*)::BIGINT AS n FROM toks t WHERE conf < 0.9 AND NOT EXISTS (SELECT 1 FROM lexicon l WHERE l.document_id = t.document_id AND l.token = t.token) GROUP BY ALL""")
def unattested_tokens(spark, sf_dir):
    pages = ocr_pages(spark, sf_dir)
    flat = _low(pages).select("document_id", F.explode(T.tokens("text")).alias("token")).filter(lexicon.eligible("token"))
    words = lexicon.build_lexicon(pages).select("document_id", "token")
    return flat.groupBy("document_id", "token").agg(F.count("*").alias("n")).join(words, ["document_id", "token"], "left_anti")


@query(with_(LINES_SQL) + r""", counts AS (SELECT document_id, cluster_key, text, count(*) AS n FROM lines GROUP BY ALL), asked AS (
  SELECT *, strip_accents(text) AS c1, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS c2 FROM counts WHERE regexp_matches(text, '[^\x00-\x7F]')
)
SELECT a.document_id, a.cluster_key, a.text, a.n AS own,
  CASE WHEN a.c1 <> a.text AND trim(a.c1) <> '' AND s1.n >= 3 AND s1.n > a.n THEN a.c1 WHEN trim(a.c2) <> '' AND s2.n >= 3 AND s2.n > a.n THEN a.c2 ELSE a.text END AS plain
FROM asked a LEFT JOIN counts s1 ON s1.document_id = a.document_id AND s1.cluster_key = a.cluster_key AND s1.text = a.c1
LEFT JOIN counts s2 ON s2.document_id = a.document_id AND s2.cluster_key = a.cluster_key AND s2.text = a.c2""")
def ascii_fold_evidence(spark, sf_dir):
    counts = canon.text_counts(ocr_pages(spark, sf_dir))
    return fold.fold_texts(counts.select(*CLUSTER, "text"), counts)


@query(with_(LINES_SQL) + r""", counts AS (SELECT document_id, cluster_key, text, count(*) AS n FROM lines GROUP BY ALL)
SELECT document_id, cluster_key, text, n FROM counts WHERE regexp_matches(text, '[^\x00-\x7F]') AND n < 3""")
def ascii_unresolved(spark, sf_dir):
    counts = canon.text_counts(ocr_pages(spark, sf_dir))
    return counts.filter(T.has_non_ascii("text") & (F.col("n") < MIN_CLEAN_SIBLINGS)).select(*CLUSTER, "text", "n")


_WRONG = ["license", "/a/", "dataa", "the", "(c)", "AB1", "--", "zzzzzzzz"]
_RIGHT = ["licence", "data", "b", "tha", "thy", "d", "AB2", "licensing"]
_RESOLVE_SQL = (
    "WITH wrong(ord, pattern) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_WRONG)) + "), vocab(entry) AS (VALUES " + ", ".join(f"('{w}')" for w in _RIGHT) + r"""), named AS (
  SELECT ord, pattern, regexp_extract(pattern, '([A-Za-z0-9](?:.*[A-Za-z0-9])?)', 1) AS core FROM wrong
), sized AS (SELECT *, CASE WHEN length(core) <= 6 THEN 1 ELSE 2 END AS budget FROM named), scored AS (
  SELECT ord, entry, levenshtein(lower(core), lower(entry)) AS d FROM sized JOIN vocab ON core <> '' AND abs(length(entry) - length(core)) <= budget
), best AS (SELECT ord, min(d) AS best FROM scored GROUP BY ord), ties AS (
  SELECT s.ord, b.best, list(s.entry ORDER BY s.entry) AS ties FROM scored s JOIN best b ON s.ord = b.ord AND s.d = b.best GROUP BY ALL
), told AS (
  SELECT n.ord, n.pattern, n.core, n.budget, t.best, t.ties, replace(n.pattern, n.core, t.ties[1]) AS rebuilt FROM sized n LEFT JOIN ties t ON n.ord = t.ord
), resolved AS (
  SELECT ord, pattern, core, rebuilt, CASE WHEN core = '' OR best IS NULL THEN 'no known pattern of comparable length'
    WHEN best > budget THEN 'nearest known pattern is ' || best || ' edits away (budget ' || budget || ')'
    WHEN len(ties) > 1 THEN 'ambiguous: ' || array_to_string(ties, ', ') || ' are equally close'
    WHEN regexp_extract_all(pattern, '\d') <> regexp_extract_all(rebuilt, '\d') THEN 'correction would alter digits' ELSE '' END AS reason FROM told
)"""
)


def _resolved(spark: SparkSession) -> DataFrame:
    vocabulary = errors.known_entries(spark.createDataFrame(list(enumerate(_RIGHT)), "ord int, term string"))
    return errors.resolve(errors.patterns_table(spark, _WRONG), vocabulary)


@query(_RESOLVE_SQL + " SELECT ord, pattern, core, CASE WHEN reason = '' THEN rebuilt END AS rebuilt, reason FROM resolved")
def error_patterns_resolve(spark, sf_dir):
    return _resolved(spark)


@query("WITH wrong(ord, pattern) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(_WRONG)) + r""") SELECT ord, pattern FROM wrong
WHERE regexp_extract(pattern, '([A-Za-z0-9](?:.*[A-Za-z0-9])?)', 1) = '' OR lower(regexp_extract(pattern, '([A-Za-z0-9](?:.*[A-Za-z0-9])?)', 1)) IN ('data', 'ab1')""")
def contradictions(spark, sf_dir):
    wrong, right = errors.patterns_table(spark, _WRONG), spark.createDataFrame([("DATA",), ("ab1",)], "entry string")
    return errors.contradictions(wrong, right).unionByName(errors.malformed(wrong))


@query(with_(LINES_SQL) + r""", told AS (
  SELECT page, line_no, text, regexp_replace(regexp_replace(text, '(^|[^\p{L}\p{N}])und($|[^\p{L}\p{N}])', '\1unt\2', 'g'), '(^|[^\p{L}\p{N}])und($|[^\p{L}\p{N}])', '\1unt\2', 'g') AS s1 FROM lines
), two AS (SELECT *, replace(s1, '(c)', '(d)') AS s2 FROM told)
SELECT page, line_no, s2 AS new_text FROM two WHERE s2 <> text""")
def error_patterns_fix(spark, sf_dir):
    vocabulary = errors.known_entries(spark.createDataFrame([(0, "unt"), (1, "d")], "ord int, term string"))
    compiled = errors.compile_patterns(errors.resolve(errors.patterns_table(spark, ["und", "(c)"]), vocabulary))
    lines = lines_of(ocr_pages(spark, sf_dir)).filter(errors.mentions("text", compiled))
    new, _ = errors.apply_patterns("text", compiled)
    return lines.withColumn("new_text", new).filter("new_text <> text").select(F.col("page_ord").alias("page"), "line_no", "new_text")


@query(with_(LINES_SQL) + r"""
SELECT page, line_no, 'the' AS pattern, 'ambiguous: tha, thy are equally close' AS detail FROM lines WHERE regexp_matches(text, '(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])')""")
def error_patterns_ambiguous(spark, sf_dir):
    vocabulary = errors.known_entries(spark.createDataFrame([(0, "tha"), (1, "thy")], "ord int, term string"))
    compiled = errors.compile_patterns(errors.resolve(errors.patterns_table(spark, ["the"]), vocabulary))
    lines = lines_of(ocr_pages(spark, sf_dir)).filter(errors.mentions("text", compiled))
    _, events = errors.apply_patterns("text", compiled)
    return lines.select(F.col("page_ord").alias("page"), "line_no", F.explode(events).alias("e")).select("page", "line_no", "e.pattern", "e.detail")


_RULES_SQL = r""", given AS (
  SELECT page, text AS original, text || '!' AS corrected, CASE WHEN page % 2 = 0 THEN 'all' ELSE 'page' END AS scope, page * 100000 + line_no AS ord FROM lines WHERE conf < 0.9 AND page % 3 = 0
  UNION ALL SELECT page, text || '~', 'never', 'all', page * 100000 + line_no + 50000 FROM lines WHERE conf < 0.9 AND page % 50 = 0 AND line_no < 50000
), won AS (
  SELECT l.page, l.line_no, l.text, g.ord, g.corrected FROM lines l JOIN given g ON l.text = g.original AND (g.scope = 'all' OR g.page = l.page)
  QUALIFY row_number() OVER (PARTITION BY l.page, l.line_no ORDER BY g.ord) = 1
)"""


def _rules(pages: DataFrame) -> DataFrame:
    low = _low(pages).select(F.col("page_ord").alias("page"), "line_no", "text")
    ord_ = F.col("page") * 100000 + F.col("line_no")
    some = low.filter("page % 3 = 0").select(ord_.alias("ord"), "page", F.col("text").alias("original"), F.concat("text", F.lit("!")).alias("corrected"), F.when(F.col("page") % 2 == 0, "all").otherwise("page").alias("scope"))
    none = low.filter("page % 50 = 0 and line_no < 50000").select((ord_ + 50000).alias("ord"), "page", F.concat("text", F.lit("~")).alias("original"), F.lit("never").alias("corrected"), F.lit("all").alias("scope"))
    return some.unionByName(none)


@query(with_(LINES_SQL) + _RULES_SQL + " SELECT page, line_no, ord, corrected AS forced FROM won WHERE corrected <> text")
def human_overlay(spark, sf_dir):
    pages = ocr_pages(spark, sf_dir)
    won = review.winning_rules(lines_of(pages).withColumn("corrected", F.col("text")), _rules(pages))
    return won.filter("corrected <> forced").select(F.col("page_ord").alias("page"), "line_no", "ord", "forced")


@query(with_(LINES_SQL) + _RULES_SQL + " SELECT ord, page, original FROM given g WHERE NOT EXISTS (SELECT 1 FROM won w WHERE w.ord = g.ord)")
def stale_rules(spark, sf_dir):
    pages = ocr_pages(spark, sf_dir)
    given = _rules(pages)
    won = review.winning_rules(lines_of(pages).withColumn("corrected", F.col("text")), given)
    return given.join(won.select("ord").distinct(), "ord", "left_anti").select("ord", "page", "original")


@query(with_(LINES_SQL) + r""", occ AS (SELECT document_id, text, count(*) AS n FROM lines GROUP BY ALL)
SELECT l.document_id, l.page, l.line_no, 'p' || lpad(l.page::VARCHAR, greatest(4, length(l.page::VARCHAR))::INT, '0') || '-' || left(sha1(l.text), 8) AS rule_id, printf('%.2f', l.conf) AS conf, o.n::VARCHAR AS occurrences
FROM lines l JOIN occ o ON o.document_id = l.document_id AND o.text = l.text WHERE l.conf < 0.9""")
def review_rows_low(spark, sf_dir):
    lines = lines_of(ocr_pages(spark, sf_dir))
    low = lines.filter(F.col("conf") < CONF_GATE)
    _, often = review.index_texts(lines, low.select("document_id", "text").distinct())
    return low.join(often, ["document_id", "text"]).select("document_id", F.col("page_ord").alias("page"), "line_no", T.rule_id("page_ord", "text").alias("rule_id"), T.two_places("conf").alias("conf"), F.col("n").cast("string").alias("occurrences"))


@query(with_(LINES_SQL) + " SELECT document_id, cluster_key, text, count(*)::BIGINT AS n, count(*) FILTER (conf >= 0.95)::BIGINT AS n_clean FROM lines GROUP BY ALL")
def occurrence_counts(spark, sf_dir):
    return canon.text_counts(ocr_pages(spark, sf_dir)).select(*CLUSTER, "text", "n", "n_clean")


@query(with_(LINES_SQL) + rf""", sized AS (
  SELECT coalesce(source, '?') AS document_id, coalesce(lang, '?') AS cluster_key, greatest(3, floor(count(*) / 4.0)) AS least FROM documents GROUP BY ALL
), counts AS (
  SELECT document_id, cluster_key, text, {STRIP.format('text')} AS s, count(*) AS n, count(*) FILTER (conf >= 0.9) AS n_confident, min((page, line_no)) AS first FROM lines GROUP BY ALL
), canonical AS (
  SELECT c.* FROM counts c JOIN sized z ON c.document_id = z.document_id AND c.cluster_key = z.cluster_key AND c.n >= z.least WHERE length(c.text) >= 8
), probe AS (
  SELECT * FROM counts c WHERE n_confident > 0 AND length(text) >= 8 AND NOT regexp_matches(text, '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b')
    AND NOT EXISTS (SELECT 1 FROM canonical k WHERE k.document_id = c.document_id AND k.cluster_key = c.cluster_key AND k.text = c.text)
), near AS (
  SELECT p.document_id, p.cluster_key, p.text, k.text AS other, k.s AS ks, k.first, {PREFIX.format('p.s', 'k.s')} AS n
  FROM probe p JOIN canonical k ON p.document_id = k.document_id AND p.cluster_key = k.cluster_key AND left(p.s, 20) = left(k.s, 20) AND p.s <> k.s
  WHERE length(p.s) >= 20 AND length(k.s) >= 20 AND NOT regexp_matches(k.text, '\b\d{{1,2}}/\d{{1,2}}/\d{{2,4}}\b') AND p.n <= greatest(1, floor(k.n * 0.25))
    AND ((NOT regexp_matches(p.text, {NUMERIC_SQL}) AND NOT regexp_matches(k.text, {NUMERIC_SQL})) OR NOT regexp_matches(k.s[{PREFIX.format('p.s', 'k.s')} + 1:], '\d'))
)
SELECT document_id, cluster_key, text, other AS canonical FROM near WHERE n >= 0.4::DOUBLE * length(ks)
QUALIFY row_number() OVER (PARTITION BY document_id, cluster_key, text ORDER BY n DESC, first) = 1""")
def prefix_disagreements(spark, sf_dir):
    pages = ocr_pages(spark, sf_dir)
    counts = canon.text_counts(pages)
    other = disagree.canonical_counts(counts, cluster_info(pages)).select(*CLUSTER, F.col("canonical").alias("other"), "support", "ord")
    probes = counts.filter((F.col("n_confident") > 0) & (F.length("text") >= 8) & ~T.has_date("text")).join(other.select(*CLUSTER, F.col("other").alias("text")), [*CLUSTER, "text"], "left_anti")
    pairs = disagree.prefix_pairs(probes.select(*CLUSTER, "text", F.col("n").alias("seen")), other).filter(disagree.eligible())
    return pairs.groupBy(*CLUSTER, "text").agg(F.min_by("other", F.struct(-F.col("shared"), F.col("ord"))).alias("canonical"))


@query(with_(LINES_SQL) + r""", bodies AS (
  SELECT coalesce(d.source, '?') AS document_id, d.doc_id AS page, '=== page ' || d.doc_id || ' ===' || chr(10) || coalesce(b.body, '') AS body
  FROM documents d LEFT JOIN (SELECT page, string_agg(text, chr(10) ORDER BY line_no) AS body FROM lines GROUP BY page) b ON b.page = d.doc_id
)
SELECT document_id, page, coalesce(sum(length(body) + 3) OVER (PARTITION BY document_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, length(body)::BIGINT AS n_chars, md5(body) AS body_md5 FROM bodies""")
def assemble_text(spark, sf_dir):
    pages = ocr_pages(spark, sf_dir).withColumn("corrected", F.transform("lines", lambda x: x["text"]))
    return sink.assembled(pages).select("document_id", F.col("page_number").alias("page"), "start", F.length("body").cast("long").alias("n_chars"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


@query(with_(LINES_SQL) + r""", drawn AS (
  SELECT page, line_no, '/F1 ' || printf('%.1f', greatest(4.0::DOUBLE, (8 + line_no % 9)::DOUBLE * 0.5::DOUBLE * 0.9::DOUBLE)) || ' Tf' || chr(10) || '1 0 0 1 ' || printf('%.1f', 10.0::DOUBLE * 0.5::DOUBLE) || ' ' ||
         printf('%.1f', 792.0::DOUBLE - (line_no * 12 + 8 + line_no % 9)::DOUBLE * 0.5::DOUBLE) || ' Tm' || chr(10) || '(' || replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)') || ') Tj' AS op
  FROM lines
), body AS (SELECT page, string_agg(op, chr(10) ORDER BY line_no) AS ops FROM drawn GROUP BY page)
SELECT d.doc_id AS page, md5(regexp_replace('BT' || chr(10) || '3 Tr' || coalesce(chr(10) || b.ops, '') || chr(10) || 'ET', '[^\x00-\xFF]', '?', 'g')) AS stream_md5 FROM documents d LEFT JOIN body b ON b.page = d.doc_id""")
def text_layer_ops(spark, sf_dir):
    pages = ocr_pages(spark, sf_dir)
    box = lambda i: F.struct(F.lit(10.0).alias("x0"), (i * 12).cast("double").alias("y0"), F.lit(99.0).alias("x1"), (i * 12 + 8 + i % 9).cast("double").alias("y1"))
    boxed = F.transform("lines", lambda x, i: F.struct(x["text"].alias("text"), box(i).alias("box")))
    stream = sink.text_layer(boxed, F.lit(792.0), F.lit(0.5), F.lit(0.5))
    return pages.select(F.col("page_ord").alias("page"), F.md5(stream.cast("binary")).alias("stream_md5"))


@query(with_(LINES_SQL) + " SELECT document_id, page AS page_number, line_no, text, conf FROM lines")
def cached_dump(spark, sf_dir):
    """Pages written as recognizer dumps (one a page) and loaded back."""
    entry = F.struct(F.transform("lines", lambda x: x["text"]).alias("txts"), F.transform("lines", lambda x: x["conf"]).alias("scores"))
    dumps = ocr_pages(spark, sf_dir).select("document_id", F.to_json(F.create_map(F.col("page_number").cast("string"), entry)).alias("json"))
    each = dumps.select(F.concat_ws("\x01", "document_id", F.md5("json")).alias("document_id"), "json")
    return lines_of(cached.dumps_to_pages(each)).select(F.substring_index("document_id", "\x01", 1).alias("document_id"), F.col("page_number").cast("long").alias("page_number"), "line_no", "text", "conf")


@query(with_(LINES_SQL) + rf"""
SELECT page, line_no, CASE WHEN starts_with({STRIP.format('text')}, '#') THEN '' ELSE {STRIP.format("regexp_replace(text, '[ " + chr(92) + "t]#.*$', '')")} END AS term FROM lines""")
def pattern_terms(spark, sf_dir):
    return lines_of(ocr_pages(spark, sf_dir)).select(F.col("page_ord").alias("page"), "line_no", terms.term_of("text").alias("term"))


@query(r"""
SELECT doc_id AS page, ['pdf', 'bundle', 'image', 'unknown'][(doc_id % 4 + 1)::INT] AS kind, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id END AS stem FROM documents""")
def sniff(spark, sf_dir):
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("255044462D312E37", "504B030400", "FFD8FFE000", "67617262")])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("page"), F.element_at(heads, (F.col("doc_id") % 4 + 1).cast("int")).alias("content"))
    name = F.when(F.col("page") % 5 == 0, "9/cover.jpg").otherwise(F.concat(F.lit("b7/page-"), F.lpad(F.col("page").cast("string"), 12, "0"), F.lit(".jpeg")))
    return docs.select("page", container.sniff().alias("kind"), container.numeric_stem(name).alias("stem"))


@query(with_(LINES_SQL) + r""", given AS (
  SELECT page * 100000 + line_no AS number, text, CASE WHEN page % 4 = 0 THEN 'x' ELSE page::VARCHAR END AS page, ['', 'page', 'all', 'some'][(line_no % 4 + 1)::INT] AS scope FROM lines WHERE conf < 0.9
)
SELECT number AS ord, page::INT AS page, trim(text, chr(32) || chr(9)) AS original, 'new' AS corrected, CASE WHEN scope = 'all' THEN 'all' ELSE 'page' END AS scope FROM given WHERE page <> 'x' AND trim(text, chr(32) || chr(9)) <> ''""")
def review_rules(spark, sf_dir):
    low = _low(ocr_pages(spark, sf_dir))
    scope = F.element_at(F.array(*[F.lit(s) for s in ("", "page", "all", "some")]), (F.col("line_no") % 4 + 1).cast("int"))
    given = low.select((F.col("page_ord") * 100000 + F.col("line_no")).alias("number"), F.lit("new").alias("corrected_text"), F.col("text").alias("original_text"), F.when(F.col("page_ord") % 4 == 0, "x").otherwise(F.col("page_ord").cast("string")).alias("page"), scope.alias("scope"))
    return rules.rules_and_warnings(given)[0].select("ord", "page", "original", "corrected", "scope")


# --- with similarity ratios ------------------------------------------------------------------


@query(with_(LINES_SQL, COUNTS_SQL, INDEX_SQL) + " SELECT document_id, cluster_key, text, support FROM line_index")
def near_miss_drop(spark, sf_dir):
    return canon.line_index(canon.text_counts(ocr_pages(spark, sf_dir))).select(*CLUSTER, "text", "support")


@query(with_(LINES_SQL, " low AS (SELECT * FROM lines WHERE conf < 0.9)", REPAIR_SQL.replace("{low}", "low")) + " SELECT document_id, page AS page_ord, line_no, repaired, guard, naive FROM repairs")
def lexicon_repair(spark, sf_dir):
    pages = ocr_pages(spark, sf_dir)
    out = lexicon.repair(_low(pages).select(*lexicon.LINE_KEY, "text"), lexicon.build_lexicon(pages))
    return out.select(*lexicon.LINE_KEY, "repaired", "guard", "naive")


@query(with_(LINES_SQL, COUNTS_SQL, _disagree_sql()) + " SELECT document_id, cluster_key, text, canonical, kind FROM contradicted")
def disagreements(spark, sf_dir):
    pages = ocr_pages(spark, sf_dir)
    counts = cut(canon.text_counts(pages))
    return disagree.disagreeing_texts(counts, disagree.canonical_counts(counts, cluster_info(pages)))


_ANCHORS = "regexp_extract_all({0}, '[A-Za-z0-9]{{3,}}')"
#: The whole chain with default settings, up to ``finals``: every line that may change, with what each step makes of it.
CHAIN_SQL = rf"""
low_lines AS (
  SELECT l.*, z.n_pages >= 4 AS can_vote, {STRIP.format('l.text')} AS s FROM lines l JOIN sized z USING (document_id, cluster_key) WHERE l.conf < 0.9
), slot_pairs AS (
  SELECT *, len(list_filter({_ANCHORS.format('s')}, lambda g: len(list_filter({_ANCHORS.format('os')}, lambda c: contains(c, g) OR contains(g, c))) > 0)) > 0 AS is_anchored FROM (
    SELECT l.document_id, l.page, l.line_no, l.s, t.text AS other, {STRIP.format('t.text')} AS os, t.support
    FROM low_lines l JOIN slots t ON l.document_id = t.document_id AND l.cluster_key = t.cluster_key AND t.support >= 3 AND t.text <> l.text
      AND ((t.side = 'top' AND t.k = l.line_no) OR (t.side = 'bottom' AND t.k = l.n_lines - 1 - l.line_no))
    WHERE l.can_vote)
  WHERE s <> '' AND os <> ''
), slot_asked AS (
  SELECT DISTINCT s AS a, os AS b FROM slot_pairs WHERE NOT is_anchored AND {bag_bound('s', 'os')} * 2 >= 0.25::DOUBLE * (length(s) + length(os))
), {ratio_parts("slot_asked", "slot_ratios")}, slot_best AS (
  SELECT document_id, page, line_no, other FROM slot_pairs p LEFT JOIN slot_ratios r ON r.a = p.s AND r.b = p.os WHERE p.is_anchored OR r.r >= 0.25::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY document_id, page, line_no ORDER BY support DESC, other DESC) = 1
), prefix_best AS (
  SELECT l.document_id, l.cluster_key, l.text, i.text AS other
  FROM (SELECT DISTINCT document_id, cluster_key, text, s FROM low_lines WHERE can_vote) l
  JOIN (SELECT *, {STRIP.format('text')} AS s FROM line_index) i ON l.document_id = i.document_id AND l.cluster_key = i.cluster_key AND left(l.s, 12) = left(i.s, 12)
  WHERE length(l.s) >= 12 AND length(i.s) >= 12 AND l.text <> i.text
  QUALIFY row_number() OVER (PARTITION BY l.document_id, l.cluster_key, l.text ORDER BY {PREFIX.format('l.s', 'i.s')} DESC, i.support DESC, i.text) = 1
), placed AS (
  SELECT l.*, coalesce(b.other, p.other) AS new_text, {STRIP.format('coalesce(b.other, p.other)')} AS new_s
  FROM low_lines l LEFT JOIN slot_best b USING (document_id, page, line_no) LEFT JOIN prefix_best p ON l.can_vote AND p.document_id = l.document_id AND p.cluster_key = l.cluster_key AND p.text = l.text
), boiler AS (
  SELECT *, CASE WHEN new_text IS NOT NULL AND {_figures_kept('text', 'new_text', 's', 'new_s')} AND {_SQUEEZED.format('text')} <> {_SQUEEZED.format('new_text')} THEN new_text END AS boilerplate,
         CASE WHEN new_text IS NOT NULL AND NOT {_figures_kept('text', 'new_text', 's', 'new_s')} THEN 'figure' END AS held_by
  FROM placed
), rest AS (
  SELECT document_id, page, line_no, text FROM boiler WHERE boilerplate IS NULL
), {REPAIR_SQL.replace("{low}", "rest")}, found AS (
  SELECT l.*, c.canonical, c.kind FROM lines l JOIN contradicted c USING (document_id, cluster_key, text) WHERE l.conf >= 0.9
), work AS (
  SELECT b.document_id, b.cluster_key, b.page, b.line_no, b.text, b.conf, b.can_vote, b.boilerplate, b.held_by, b.new_text, r.repaired, r.guard, r.naive FROM boiler b LEFT JOIN repairs r USING (document_id, page, line_no)
  UNION ALL SELECT document_id, cluster_key, page, line_no, text, conf, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM lines WHERE conf >= 0.9 AND regexp_matches(text, '[^\x00-\x7F]')
  UNION ALL SELECT document_id, cluster_key, page, line_no, text, conf, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM found WHERE kind <> 'disagrees' AND NOT regexp_matches(text, '[^\x00-\x7F]')
), step2 AS (
  SELECT *, coalesce(boilerplate, repaired, text) AS s2 FROM work
), spelled AS (
  SELECT document_id, cluster_key, s2, coalesce(o.n, 0) AS own,
         CASE WHEN c1 <> s2 AND {STRIP.format('c1')} <> '' AND e1.n >= 3 AND e1.n > coalesce(o.n, 0) THEN c1 WHEN c2 <> s2 AND {STRIP.format('c2')} <> '' AND e2.n >= 3 AND e2.n > coalesce(o.n, 0) THEN c2 ELSE s2 END AS plain
  FROM (SELECT DISTINCT document_id, cluster_key, s2, strip_accents(s2) AS c1, regexp_replace(strip_accents(s2), '[^\x00-\x7F]', '', 'g') AS c2 FROM step2 WHERE regexp_matches(s2, '[^\x00-\x7F]')) x
  LEFT JOIN (SELECT document_id, cluster_key, text AS s2, n FROM counts) o USING (document_id, cluster_key, s2)
  LEFT JOIN (SELECT document_id, cluster_key, text AS c1, n FROM counts) e1 USING (document_id, cluster_key, c1)
  LEFT JOIN (SELECT document_id, cluster_key, text AS c2, n FROM counts) e2 USING (document_id, cluster_key, c2)
), step3 AS (
  SELECT w.*, CASE WHEN p.plain <> w.s2 THEN p.plain END AS ascii, coalesce(p.plain = w.s2 AND p.own < 3, false) AS is_unresolved FROM step2 w LEFT JOIN spelled p USING (document_id, cluster_key, s2)
), adopted AS (
  SELECT DISTINCT document_id, page, text, canonical FROM found WHERE kind <> 'disagrees'
), step4 AS (
  SELECT w.*, coalesce(w.ascii, w.s2) AS s4, CASE WHEN coalesce(w.boilerplate, w.repaired, w.ascii) IS NULL AND a.canonical <> coalesce(w.ascii, w.s2) THEN a.canonical END AS typography
  FROM step3 w LEFT JOIN adopted a USING (document_id, page, text)
), done AS (
  SELECT *, coalesce(typography, s4) AS final FROM step4
), changes AS (
  SELECT document_id, page, line_no, 1 AS seq, 'boilerplate' AS kind, text AS old, boilerplate AS new FROM done WHERE boilerplate IS NOT NULL
  UNION ALL SELECT document_id, page, line_no, 2, 'lexicon', text, repaired FROM done WHERE repaired IS NOT NULL
  UNION ALL SELECT document_id, page, line_no, 3, 'ascii', text, ascii FROM done WHERE ascii IS NOT NULL
  UNION ALL SELECT document_id, page, line_no, 5, 'typography', text, typography FROM done WHERE typography IS NOT NULL
), finals AS (
  SELECT l.document_id, l.cluster_key, l.page, l.line_no, l.n_lines, l.text, l.conf, coalesce(d.final, l.text) AS corrected FROM lines l LEFT JOIN done d USING (document_id, page, line_no)
)"""
_CHAIN = with_(LINES_SQL, COUNTS_SQL, SLOTS_SQL, INDEX_SQL, _disagree_sql(), CHAIN_SQL)


def _quoted_sql(c: str) -> str:
    one, two, back = "chr(39)", "chr(34)", "chr(92)"
    raw = f"replace(replace(replace(replace({c}, {back}, {back} || {back}), chr(10), {back} || 'n'), chr(13), {back} || 'r'), chr(9), {back} || 't')"
    return f"CASE WHEN contains({c}, {one}) AND NOT contains({c}, {two}) THEN {two} || {raw} || {two} ELSE {one} || replace({raw}, {one}, {back} || {one}) || {one} END"


#: Rows of a review file: changes, disagreements, guards, spellings without evidence, lines left.
REVIEW_SQL = rf"""
, flagged AS (
  SELECT document_id, page, line_no, 0 AS part, kind AS status, old AS original, new AS tool, CASE WHEN kind = 'typography' THEN 'spacing, punctuation or case adopted from the canonical' ELSE '' END AS notes, NULL::DOUBLE AS own_conf, NULL AS other FROM changes
  UNION ALL SELECT document_id, page, line_no, 1, kind, text, text, '', conf, canonical FROM found f WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.document_id = f.document_id AND c.page = f.page AND c.old = f.text)
  UNION ALL SELECT document_id, page, line_no, 3, 'protected', text, text, held_by || ' guard prevented ' || {_quoted_sql('new_text')}, NULL, NULL FROM done WHERE held_by IS NOT NULL
  UNION ALL SELECT document_id, page, line_no, 3, 'protected', text, text, guard || ' guard prevented ' || {_quoted_sql('naive')}, NULL, NULL FROM done WHERE guard IS NOT NULL
  UNION ALL SELECT document_id, page, line_no, 4, 'nonascii', s2, s2, 'non-ASCII character with no corpus evidence for folding', conf, NULL FROM done WHERE is_unresolved
  UNION ALL SELECT document_id, page, line_no, 5, 'uncorrected', text, text, CASE WHEN can_vote THEN 'fewer than 3 clean sibling reads for this line' ELSE 'format cluster too small for consensus (needs 4 pages)' END, conf, NULL
    FROM done WHERE conf < 0.9 AND coalesce(boilerplate, repaired, ascii, typography) IS NULL
), read_on AS (
  SELECT document_id, page, text AS original, arg_max(conf, line_no) AS page_conf FROM lines GROUP BY ALL
), often AS (SELECT document_id, text, count(*) AS n FROM lines GROUP BY ALL)
SELECT document_id, 'p' || lpad(page::VARCHAR, greatest(4, length(page::VARCHAR))::INT, '0') || '-' || left(sha1(original), 8) AS rule_id, document_id AS file, page::VARCHAR AS page,
       CASE WHEN part = 3 THEN '' WHEN part = 0 THEN printf('%.2f', coalesce(page_conf, 0.0::DOUBLE)) ELSE printf('%.2f', own_conf) END AS conf, coalesce(o.n, 1)::VARCHAR AS count, status,
       original AS original_text, tool AS tool_text, '' AS corrected_text, '' AS scope,
       CASE WHEN part = 1 THEN 'confident, but ' || coalesce(x.n, 0) || ' pages read ' || {_quoted_sql('other')} ELSE notes END AS notes
FROM flagged f LEFT JOIN read_on r USING (document_id, page, original) LEFT JOIN (SELECT document_id, text AS original, n FROM often) o USING (document_id, original) LEFT JOIN (SELECT document_id, text AS other, n FROM often) x USING (document_id, other)"""
#: What corrected pages teach: slots, and standing lines without near misses.
LEARNED_SQL = rf"""
, trusted AS (
  SELECT *, corrected AS t FROM finals WHERE NOT regexp_matches(corrected, {NUMERIC_SQL}) AND (conf >= 0.95 OR corrected <> text)
), learned_slots AS (
  SELECT document_id, cluster_key, side || ':' || k AS slot, t AS text FROM (
    SELECT document_id, cluster_key, side, k, t, count(*) AS n FROM (
      SELECT document_id, cluster_key, 'top' AS side, line_no AS k, t FROM trusted UNION ALL SELECT document_id, cluster_key, 'bottom', n_lines - 1 - line_no, t FROM trusted) WHERE k < 4 GROUP BY document_id, cluster_key, side, k, t
    QUALIFY row_number() OVER (PARTITION BY document_id, cluster_key, side, k ORDER BY count(*) DESC, t) = 1)
  WHERE n >= 3
), learned AS (
  SELECT document_id, cluster_key, t AS text, count(*) AS n FROM trusted WHERE length(t) >= 18 GROUP BY ALL HAVING count(*) >= 3
), learned_pairs AS (
  SELECT DISTINCT t.text AS a, f.text AS b FROM learned t JOIN learned f USING (document_id, cluster_key) WHERE {_TWIN} AND {bag_bound('t.text', 'f.text')} * 2 >= 0.9::DOUBLE * (length(t.text) + length(f.text))
), {ratio_parts("learned_pairs", "learned_ratios")}
SELECT document_id, cluster_key, slot, text FROM learned_slots
UNION ALL SELECT document_id, cluster_key, 'line', text FROM learned t
WHERE NOT EXISTS (SELECT 1 FROM learned f JOIN learned_ratios r ON r.b = f.text WHERE f.document_id = t.document_id AND f.cluster_key = t.cluster_key AND r.a = t.text AND {_TWIN} AND r.r >= 0.9::DOUBLE)"""


def corrected(spark: SparkSession, sf_dir: str) -> Correction:
    return correct(ocr_pages(spark, sf_dir))


@query(_CHAIN + " SELECT document_id, page AS page_ord, line_no, text, conf, corrected FROM finals")
def correct_lines(spark, sf_dir):
    return corrected(spark, sf_dir).lines.select("document_id", "page_ord", "line_no", "text", "conf", "corrected")


@query(_CHAIN + " SELECT document_id, page AS page_ord, page AS page_number, line_no, seq, kind, old, new FROM changes")
def correct_changes(spark, sf_dir):
    return corrected(spark, sf_dir).changes


@query(_CHAIN + REVIEW_SQL)
def review_rows(spark, sf_dir):
    return review.build_rows(corrected(spark, sf_dir)).drop("seq")


@query(_CHAIN + LEARNED_SQL)
def learned_profile(spark, sf_dir):
    """What ``review.profile_json`` nests, as rows; its JSON has tests of its own."""
    slots, lines = review.learn_profile(corrected(spark, sf_dir).pages)
    named = slots.select(*CLUSTER, F.concat_ws(":", "side", "k").alias("slot"), "text")
    return named.unionByName(lines.select(*CLUSTER, F.lit("line").alias("slot"), "text"))
