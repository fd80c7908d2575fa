"""From raw documents to token ids: toxicity, near duplicates, repeated strings, benchmark leaks, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.bpe import bpe_encode
from veilframe.llm.decontam import decontaminated
from veilframe.llm.ngram_join import ngram_join
from veilframe.llm.suffix_dedup import suffix_dedup
from veilframe.llm.toxicity import learned_from, toxicity
from veilframe.plans.staging import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    lexicon = learned_from(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity(docs.select(*COLUMNS), lexicon).filter("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, the first by id (nulls last); documents without words stay."""
    docs = docs.select(*COLUMNS)
    most, nulls = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(
        F.max("n"), F.count_if(F.col("doc_id").isNull())).first()
    if not nulls and (most or 0) <= 1:
        groups = ngram_join(docs).filter("doc_id != component").select(F.col("doc_id").alias("__copy"))
        return docs.join(groups, F.col("doc_id") == F.col("__copy"), "left_anti")
    # The ids do not tell the rows apart: written down with a key for each, they are grouped and dropped by that.
    rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()))
    groups = stage(ngram_join(rows, id_col="__row").select("__row", "component"))
    first = groups.join(rows.select("__row", "doc_id"), "__row").groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    return rows.join(first.select(F.col("first.__row").alias("__row")), "__row", "left_semi").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents; a character cut in two becomes U+FFFD."""
    kept = suffix_dedup(docs, carry=["lang", "source"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return kept.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text."""
    found = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN,
                       keep=["doc_id", "lang", "source"])
    return found.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontam", drop_leaks),
    ("bpe", encode),
]

# Weights, latent spaces and merges are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
