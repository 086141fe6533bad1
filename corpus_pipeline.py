"""A corpus pipeline: quality rules, near-duplicates, personal data, source mix, token ids.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and returns them, the
last one its token table. Between stages the rows are a Parquet table.

Cases: a table without rows passes through; nulls are handled as each operator states; a row that
the mix takes twice is two rows, with the same id, from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dealforge.llm import bpe, jaccard, mixing, pii, quality
from dealforge.llm.common import read, saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and lie in their language's perplexity band."""
    return quality.assess(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of word shingles connect: the one of least id."""
    return jaccard.one_of_each(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; ``n_chars`` follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it."""
    return mixing.mixed_rows(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids of each text, and whether they decode to it."""
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), decoded_col="decoded")
    whole = ids.withColumn("round_trip", F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary"))
    return whole.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: Perplexity bands and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
