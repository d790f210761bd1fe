"""Queries of near-duplicates: vectors (1), shingle sets (7), repeated passages (8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mapweft.llm.jaccard import similar_documents
from mapweft.llm.near_vectors import link_vectors
from mapweft.llm.suffixes import remove_repeats


def op1_link_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with their links of cosine 0.95 or more."""
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.95)


def op7_join_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the group that Jaccard links of 0.8 or more put them in."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 80).select("doc_id", "n_shingles", "component_id")


def op8_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 50-byte strings that a smaller document has."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), outputs=False)


QUERIES = {"op1_link_vectors": op1_link_vectors, "op7_join_similar": op7_join_similar, "op8_remove_repeats": op8_remove_repeats}
