"""Corpus pipeline: documents to mixed token files.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, sf_dir)
and returns a DataFrame, which is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, mixing, near_dedup, quality, tokens
from tidemark.llm.common import Numbered, forget, row_key, stored
from tidemark.llm.queries import table, tokenizer_path

#: No SQL expresses the classifier; the stages are tested against brute force.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from labels, accepts. A null
    text is judged as an empty one; without labels all documents stay; columns
    are kept whatever their names; an empty table stays empty."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the
    one with the smallest id. Documents without words stay; of repeated rows one
    stays; an empty table stays empty."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark. Rows are matched by a
    64-bit hash of id and text, so null and repeated ids are judged row by row;
    null texts stay; an empty test set or table changes nothing."""
    own = Numbered(docs)
    rows = own.rows.withColumn("key", F.xxhash64(row_key(own.column("doc_id", "long"), own.column("text", "string"))))
    index = decontam.build_index(rows.select(F.col("key").alias("doc_id"), own.column("text", "string").alias("text")))
    hit = stored(decontam.search(index, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "hit")
    forget(index)
    return own.restored(rows.join(hit, "key", "left_anti"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks, once at least. A
    null source is a source; rows without tokens are used like their source's
    others; an empty table stays empty."""
    return mixing.realise(docs.toDF(*(f"{c}{'_' * (c.lower() in ('epoch', 'position'))}" for c in docs.columns)), mixing.plan(docs)).drop("epoch", "position").toDF(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold of each document, a row for each use
    of it. A null text has the end id only; an empty table has no row."""
    return tokens.read_back(tokens.bases(tokens.encode_to_files(docs, tokenizer_path())))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's result stored for the next."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)  # the next stage's rows are written
        before = docs
    return docs
