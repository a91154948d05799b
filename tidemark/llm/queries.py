"""The registered queries of the training-data operators.

Each query applies its operator with production parameters to its whole table
and derives the digest columns of its contract from the operator's output.
``ORACLES`` holds the SQL of those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, media, mixing, near_dedup, oracles, quality, secret_scan, suffix_dedup, tokens

#: The public tokenizer of the token-ID output; a parameter of the operator.
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.cut(table(spark, sf_dir, "documents")))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_columns(table(spark, sf_dir, "documents")))


def fold(of: int) -> Column:
    """crc32 of doc_id's decimal digits, modulo ``of``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mix = mixing.plan(docs)
    used = mixing.realise(docs, mix)
    return used.select("doc_id", "source", "epoch", "position")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold(5) != 0))
    return langid.predict(docs, model).withColumn("held_out", fold(5) == 0).select("doc_id", "held_out", "lang_pred", "score", "bits", "accepted")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(fold(3) != 1))
    return quality.score(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    return decontam.search(index, table(spark, sf_dir, "benchmark")).drop("item_ids")


def op9_decontamination_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches. The columns that op9's SQL lacks stand here."""
    index = decontam.build_index(table(spark, sf_dir, "documents"))
    return decontam.search_near(index, table(spark, sf_dir, "benchmark")).drop("item_ids", "near_ids")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = tokens.encode_to_files(table(spark, sf_dir, "documents"), tokenizer_path())
    return tokens.read_back(tokens.bases(parts))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_media_columns": op4_media_columns,
    "op5_source_mixing": op5_source_mixing,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_decontamination": op9_decontamination,
    "op9_decontamination_near": op9_decontamination_near,
    "op10_token_files": op10_token_files,
}

ORACLES: dict[str, str] = oracles.SQL
