"""A training corpus from ``documents``: reject, clean, deduplicate, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. The last gives the piece ids of every document of the mix.

Defined cases, stage by stage: a document with null or empty text isn't toxic, has one empty
line that isn't dropped, is near nothing, has size 0 in the mix and so is taken no more often
than its source's target asks, and has no pieces; rows with a null doc_id are kept by
near-dedup; rows that repeat a doc_id are documents of their own in all stages but near-dedup,
which keeps or drops them together; without labels nothing is toxic; an empty table gives an
empty result. Columns beside those of documents pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemend.llm import line_dedup, mixing, near_dedup, pieces, toxicity
from pagemend.llm.common import delete_uri, scratch_uri
from pagemend.llm.queries import tokenizer_file


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity isn't above the model's cut."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_texts(docs, model).filter("not __toxicity.toxic").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three documents stay in the last of them; a document left with no text goes."""
    out = line_dedup.dedup_lines(docs).withColumn("__text", F.col("__lines.kept").cast("string"))
    kept = out.filter("__lines.n_dropped = 0 or length(__text) > 0")
    changed = {"text": F.when(F.col("__lines.n_dropped") > 0, F.col("__text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("__lines.n_dropped") > 0, F.length("__text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8)."""
    return near_dedup.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target asks."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and the piece ids (little-endian u32) of each document of the mix."""
    out = pieces.encode_texts(docs, tokenizer_file("piece_bpe_32k.model"), with_ids=True)
    return out.select("doc_id", "source", "__pieces.*")


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("sentence_pieces", encode),
]
#: Neither the fitted model nor the encoder can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        where = scratch_uri(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        if read:
            delete_uri(spark, read)  # what the stage has read
        docs, read = spark.read.parquet(where), where
    return STAGES[-1][1](spark, docs, sf_dir)  # reads the last folder, which therefore stays
