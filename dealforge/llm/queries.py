"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, brown, chat, embeddings, jaccard, language, merkle, mixing, oracles, pii, quality, repair, repeats, sharding, structure_oracles
from .common import read, saved

QUERIES: dict = {}
ORACLES: dict[str, str] = oracles.ORACLES | structure_oracles.ORACLES


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = brown.score_corpus(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(read(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "pii")
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii")).alias("spans"))


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embeddings.near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"], decoded_col="decoded")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = saved(read(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")), "mix-sizes")
    out = mixing.mix(sized, mixing.plan_mix(sized))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.link_components(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.assess(read(spark, sf_dir, "documents", "doc_id", "text", "lang"), keep=["doc_id", "lang"])
    return out.select("doc_id", *quality.COUNTS, "base_failed", "kept", "lang", "log_ppl")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by all four kinds of evidence; documents by their text and their source as host."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    page = read(spark, sf_dir, "pages", "page_id", "url", "html")
    nothing = F.lit(None).cast("string")
    page = page.select(F.lit(None).cast("bigint").alias("doc_id"), "page_id", language.visible_text(F.col("html")).alias("text"), language.host(F.col("url")).alias("host"), language.declared(F.col("html")).alias("declared"))
    page = page.withColumn("suffix", language.suffix(F.col("host")))
    rows = page.unionByName(docs.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), "text", F.concat(F.lit("source:"), "source").alias("host"), nothing.alias("declared"), nothing.alias("suffix")))
    return language.identify(rows, language.train(docs), keep=["doc_id", "page_id"])


@query
def op8_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat.preference_rows(*chat.crossed(turns))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repair.repair(repair.damage(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's crc32 is even are checked without the newlines of their text."""
    ident = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    now = F.when(ident % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.audit(read(spark, sf_dir, "documents", *merkle.FIELDS), {"text": now}).withColumnRenamed("id", "doc_id")


@query
def op13_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign(read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    return out.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
