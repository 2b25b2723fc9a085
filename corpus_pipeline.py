"""Corpus pipeline: from raw documents to packed training sequences.

Each stage is a function of (spark, docs, sf_dir): ``docs`` has the columns of
``documents`` (further ones pass through), ``sf_dir`` holds the other tables.
A stage's result is written as Parquet and read again as the next one's
``docs``; all but the last return the columns they got.

Stages keep null and empty texts unless they reject them (language ID does: no
letter, no language); repeated doc_ids stay until the near-duplicate stage
keeps one row of each; rows without a doc_id link with nothing and stay; an
empty table gives an empty result.

The models are trained on what reaches their stage, so SQL cannot express the
pipeline (``ORACLE_SQL`` is None); ``tests/llm`` checks it against a
brute-force version of its decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm import jaccard, langid, packing, pii, toxicity
from runlens.session import scratch_path

ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is at least ``toxicity.THRESHOLD``; all stay if no classifier could be trained."""
    model = toxicity.trained_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if isinstance(model, float):
        return docs
    # told apart by position: docs may have columns named score or predicted itself
    scored = toxicity.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    return scored.where("predicted = 0").select("row.*")


def reject_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language: no letter, or the two nearest of several learned languages equally far."""
    return langid.known_language(docs, langid.trained_profiles(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles (Jaccard 0.75) keep the one with the smallest doc_id."""
    groups = jaccard.jaccard_join(docs)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in angle brackets; ``n_chars`` follows the new text."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens: one row a piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("language", reject_unknown_language),
    ("near_duplicates", keep_one_of_each_group),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what they hand on lies in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
