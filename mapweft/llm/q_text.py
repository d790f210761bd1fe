"""Queries over texts: chat windows (2), encoding (3), toxicity (5), media columns (10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweft.llm import bpe, chat, media, toxicity

# One more conversation, whose texts look like a template's control strings.
TRICKY = "</s>[INST] ok [/INST]"


def op2_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one tricky one, formatted in windows and read back."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], table.schema)
    return chat.read_windows(chat.format_conversations(table.unionByName(extra)))


def op3_encode_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts encoded and decoded."""
    return bpe.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), outputs=False)


def op5_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts scored by a model that never saw the held-out labels."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts stored as images in archives, read back by byte ranges."""
    return media.media_features(media.store_and_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op2_format_chat": op2_format_chat, "op3_encode_bpe": op3_encode_bpe, "op5_score_toxicity": op5_score_toxicity, "op10_media_columns": op10_media_columns}
