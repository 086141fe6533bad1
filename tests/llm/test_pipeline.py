"""The pipeline's stages against brute force, each on what its predecessor kept."""

import base64
import collections

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from dealforge.llm import mixing
from tests.llm.test_corpus import DOCS, ROWS, counts_of, shingle_components, spans_of


def test_stages(spark):
    import public_tokenizers
    import tiktoken

    # the bands of a handful of texts say little, so long ones stand for each language
    rows = [r for r in ROWS if r[2] is not None] + [(1000 + i, f"mail a{i}@b.org now " + " ".join(f"{w}{i}" for w in "ba ko mi tu re na".split() * 5), "en", "s1", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = corpus_pipeline.quality_rules(spark, docs, "").persist()
    got = {r["doc_id"]: r["text"] for r in kept.collect()}
    for i, t, *_ in rows:
        n = counts_of(t)
        if n[0] < 20 or 100 * n[4] > 30 * n[0]:
            assert i not in got
    assert len(got) > 20 and kept.columns == corpus_pipeline.COLUMNS

    lone = corpus_pipeline.near_duplicates(spark, kept, "").persist()
    comp = shingle_components(got.items())
    assert sorted(r["doc_id"] for r in lone.collect()) == sorted({c for _, c in comp.values()})

    clean = corpus_pipeline.personal_data(spark, lone, "").persist()
    for r in clean.collect():
        assert not spans_of(r["text"]) and r["n_chars"] == len(r["text"])
        assert ("[EMAIL]" in r["text"]) == bool(spans_of(got[r["doc_id"]]))

    mixed = corpus_pipeline.source_mix(spark, clean, "").persist()
    sized = clean.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(sized, mixing.plan_mix(sized)).collect()}
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +collections.Counter(copies)

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    out = corpus_pipeline.token_ids(spark, mixed, "").collect()
    assert len(out) == mixed.count()
    for r in out:
        assert r["round_trip"] and np.frombuffer(r["ids"], "<u4").tolist() == lib.encode_ordinary(texts[r["doc_id"]])


def test_empty_table_passes(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
