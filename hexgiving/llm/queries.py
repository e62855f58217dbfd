"""Registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from hexgiving.llm import (bestfit, interpolation, minhash, multiindex, substring, tiling, tokenbits, tokencount, toxicity, urlfilter,
                           variants, warc, whitening)
from hexgiving.llm.common import fold, stored
from hexgiving.session import shared_dir

URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"),
             ("com/de/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.rules_table(spark, URL_RULES))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text", words=2, percent=80)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_documents(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), 2, 1024)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return r.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op6_token_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "llm-token-files")
    tokenbits.write_tokens(_table(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"), 49_408, 1)
    return tokenbits.read_tokens(spark, path).withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), train=toxicity.training_rows())
    scored = toxicity.with_scores(docs, model, out="score")
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = multiindex.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
    return r.withColumnRenamed("id", "vec_id")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(_table(spark, sf_dir, "documents"))


def _repeats(spark: SparkSession, sf_dir: str, split) -> DataFrame:
    r = substring.repeated_units(_table(spark, sf_dir, "documents"), split=split)
    return r.select(F.col("id").alias("doc_id"), "start", "end", "n_words", F.col("first_id").alias("first_doc_id"),
                    "first_start")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single sentences alone: what its SQL lists."""
    return _repeats(spark, sf_dir, substring.sentences)


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of short sentences too; no SQL."""
    return _repeats(spark, sf_dir, substring.passages)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = variants.letter_runs(_table(spark, sf_dir, "documents"), least_length=5)
    words = variants.word_counts(runs.select(variants.slipped(F.col("run"), F.col("id"), 97).alias("word")), least_length=5, least_count=3)
    return variants.group_variants(words, times=2).select("word", "form", "root", "n", "n_near", "form_n")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(whitening.scaled(_table(spark, sf_dir, "embeddings")), "scaled-vectors")
    model = whitening.fit_whitening(rows, components=16)
    whitened = whitening.whiten(rows, model).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(e) for e in model.explained())) if model.n else F.array(F.lit(0.0))
    return whitened.select(F.col("id").alias("vec_id"), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                           "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"),
                           F.lit(model.identity_error).cast("double").alias("identity_error"))


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "llm-warc")
    warc.write_archive(_table(spark, sf_dir, "pages"), path)
    r = warc.record_facts(spark, path)
    return r.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_url_filter, op3_minhash_near_dedup, op4_best_fit_packing,
    op5_benchmark_decontamination, op6_token_bits, op7_toxicity,
    op8_nearest_neighbours, op9_language_model, op10_substring_dedup, op10_passage_dedup, op11_spelling_variants,
    op12_embedding_whitening, op13_warc_archive)}
QUERIES["pipeline"] = corpus_pipeline.run
