"""Thin queries of the operators, with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, line_dedup, media, mixing, near_dedup, pieces, secret_scan, token_store, toxicity


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan_secrets(docs, tokenizer_file("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "__secrets.*")


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_store.store_round_trip(docs, tokenizer_file("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, texts=False)
    return out.select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.col("__lines.sha256").alias("kept_sha256"))


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT r, doc_id, i, parts[i] AS line FROM docs, unnest(range(1, len(parts) + 1)) AS t(i)
), keyed AS (
  SELECT r, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), held AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT r) >= 3
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (last IS NOT NULL AND doc_id < last)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last IS NULL OR doc_id = last), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (k) GROUP BY r, doc_id
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    formatted = chat.format_trees(chat.chain_nodes(rows.unionByName(extra)))
    turns = formatted.withColumn("turns", chat.parse_turns(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("formatted"), F.col("loss_spans"))
    return turns.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(url_encode(role)) + 2 + length(regexp_replace(text, '([\\<#])', '#\1', 'g')) + 9)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "source", mixing.with_size(docs).alias("size"))
    mixed = mixing.systematic_copies(narrow)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH docs AS (
  SELECT doc_id, source IS NULL AS src_null, coalesce(source, '') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT src_null, src, sum(size)::BIGINT AS source_size FROM docs GROUP BY ALL
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY src_null, src) - 1) % 3 + 1)::INT] AS weight,
         source_size * 3.0::DOUBLE AS cap
  FROM sources
), level AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, src_null, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, src_null, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM weighed
), water AS (
  SELECT arg_min(share, (cap / weight, src_null, src)) AS l FROM level WHERE cap >= weight * share
), placed AS (
  SELECT src_null, src, source_size, CASE WHEN l IS NULL THEN cap ELSE least(cap, weight * l) END AS target,
         (('0x' || substr(md5('17|' || src_null::INT::VARCHAR || '|' || src), 1, 8))::BIGINT % 1048576)::DOUBLE / 1048576.0::DOUBLE AS u
  FROM level, water
), ranked AS (
  SELECT doc_id, size, source_size, target, u, row_number() OVER (PARTITION BY src_null, src ORDER BY size, doc_id) AS r,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS e
  FROM docs JOIN placed USING (src_null, src)
)
SELECT doc_id, size, source_size, target, ((floor(e * r + u) - floor(e * (r - 1) + u))::BIGINT * size)::BIGINT AS taken FROM ranked
"""


QUERIES = {
    "op4_secret_scans": op4_secret_scans,
    "op5_token_output": op5_token_output,
    "op6_line_dedup": op6_line_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_mixing": op10_mixing,
}
ORACLES = {"op6_line_dedup": OP6_SQL, "op9_chat_format": OP9_SQL, "op10_mixing": OP10_SQL}


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(read(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM words
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS v FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.v = b.v AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(node, root) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT p.b, r.root FROM reach r JOIN pairs p ON p.a = r.node WHERE r.root < p.b
)
SELECT s.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(r.root) AS component_id, min(r.root) = s.doc_id AS kept
FROM sets s JOIN reach r ON r.node = s.doc_id GROUP BY s.doc_id
"""
QUERIES["op7_near_dedup"] = op7_near_dedup
ORACLES["op7_near_dedup"] = OP7_SQL


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_texts(docs, tokenizer_file("piece_bpe_32k.model")).select("doc_id", "__pieces.*")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score_texts(docs, model).select("doc_id", "__toxicity.*")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "__media.*")


QUERIES |= {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_sentence_pieces": op2_sentence_pieces,
    "op3_toxicity": op3_toxicity,
    "op8_media_columns": op8_media_columns,
}
