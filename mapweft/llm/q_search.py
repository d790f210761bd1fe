"""Queries of the filter audit (11), periodic runs (12) and nearest neighbours (13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweft.llm.audit import audit_filters
from mapweft.llm.forest import nearest
from mapweft.llm.runs import collapse_runs

NEAREST = 20

OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS words FROM t),
f AS (
  SELECT doc_id, part,
         (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS cell
  FROM w),
m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, cell, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN m USING (doc_id) GROUP BY part, cell),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter),
o AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM l a JOIN l b ON a.letter <> b.letter JOIN l c ON c.letter NOT IN (a.letter, b.letter)
  JOIN l d ON d.letter NOT IN (a.letter, b.letter, c.letter) JOIN l e ON e.letter NOT IN (a.letter, b.letter, c.letter, d.letter)),
s AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o),
b AS (
  SELECT *, 1 << (ascii(filter_order[step]) - 65) AS own,
         coalesce(list_sum([1 << (ascii(filter_order[i]) - 65) for i in range(1, step)]), 0)::BIGINT AS before
  FROM s),
r AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE cell & (before | own) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE cell & before = 0 AND cell & own <> 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE cell & before <> 0 AND cell & own <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE cell = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE cell & before = 0 AND cell & own <> 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE cell & before = 0 AND cell & own <> 0), 0) AS toxic_lost
  FROM c CROSS JOIN b GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


def op11_audit_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents, in every order, by source."""
    return audit_filters(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them with a tail that repeats: which, where and how is drawn from the id."""
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "[ \t-\r]+"), lambda w: w != "")
    draw = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(draw / 10), F.size("words")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    drawn = docs.select("doc_id", "text", F.when(draw % 10 == 0, words).alias("words"), g.alias("g"))
    placed = drawn.withColumn("a", F.when(F.size("words") > 0, a)).withColumn("p", F.when(F.size("words") > 0, p))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def op12_collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents, some of them planted."""
    return collapse_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")), outputs=False)


def op13_search_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector, by inner product."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, NEAREST)


QUERIES = {"op11_audit_filters": op11_audit_filters, "op12_collapse_runs": op12_collapse_runs, "op13_search_nearest": op13_search_nearest}
ORACLES = {"op11_audit_filters": OP11_SQL}
