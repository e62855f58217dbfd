"""A training-corpus pipeline over ``documents``: five stages, each one operator of the llm package.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each result as Parquet under the shared checkpoint folder and reads it
back as the next stage's documents. All stages but the last return the
columns of documents. Null ids and texts, empty tables, repeated rows and
extra columns pass through as each stage's docstring says.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexgiving.llm import bestfit, minhash, substring, tiling, toxicity
from hexgiving.llm.common import stored

TOXIC = 0.3
SEQUENCE = 1024
END_ID = 2
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 2000       # texts on their way to a Python worker at a time; results do not depend on it


def small_batches(stage):
    """``stage`` with Arrow batches of at most ``BATCH_ROWS`` rows, where the session sets no size of its own."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH, None) is None:
            spark.conf.set(BATCH, str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.3. Labels are learned from as far as their documents are still there.

    Null and empty texts score low and stay; repeated rows share a score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn(docs, labels, train=toxicity.training_rows())
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return toxicity.with_scores(docs, model, out=name).where(F.col(name) < TOXIC).drop(name)


@small_batches
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group linked by five-word shingles at 0.8.

    Documents without words and null ids stay. Of rows that repeat a kept id,
    one for each distinct text stays.
    """
    marks = minhash.near_duplicates(docs, words=5, percent=80)
    marks = stored(marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1"), "marks")
    dropped, repeated = marks.where("NOT kept").select("doc_id"), marks.where("kept").select("doc_id")
    left = docs.join(dropped, "doc_id", "left_anti")
    once = left.join(repeated, "doc_id", "left_anti")
    return once.unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


@small_batches
def drop_repeated_units(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every repeated sentence, line or run of short sentences but its earliest occurrence cut from the texts; ``n_chars`` follows.

    All rows stay, with an empty text if nothing else was in it; null texts stay null.
    """
    cut = substring.remove_repeats(docs)
    size = F.when(F.col("removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cut.withColumn("n_chars", size).select(docs.columns)


@small_batches
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover less than 0.7 of every benchmark item. Null ids, short and null texts stay unless covered.

    Of rows that share an id (or have none), those whose own text is covered go.
    """
    found = tiling.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_text=True)
    gone = stored(found.select("id", "text_hash").distinct(), "contaminated")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["id"]) & (F.xxhash64(docs["text"]) == gone["text_hash"]), "left_anti")


@small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed into sequences of 1024: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset."""
    import public_tokenizers
    return bestfit.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, SEQUENCE, keep_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("substring_dedup", drop_repeated_units),
          ("decontamination", drop_contaminated), ("packing", pack)]

# Viterbi decoding, MinHash, tiling and best-fit packing have no SQL; the tests use brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
