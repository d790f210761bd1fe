"""Queries of the operators that SQL can express: mixing (4), sharding (6), line removal (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweft.llm.lines import drop_spread_lines
from mapweft.llm.mixing import mix
from mapweft.llm.shards import shard_by_bytes

SHARDS = 40
MIN_SITES = 5

WORDS = r"len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> ''))::BIGINT"

OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, {WORDS} AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total,
         sum(weight) OVER ()::BIGINT AS weights,
         coalesce(sum(3 * source_size) OVER w, 0)::BIGINT AS caps_before,
         coalesce(sum(weight) OVER w, 0)::BIGINT AS weights_before
  FROM s WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - caps_before) / (weights - weights_before) AS level FROM r),
u AS (
  SELECT source, source_size,
         least(cap::DOUBLE, weight * (SELECT coalesce(arg_min(level, cap / weight) FILTER (WHERE cap > weight * level), 'infinity'::DOUBLE) FROM l)) AS target
  FROM l),
p AS (
  SELECT d.*, u.source_size, u.target,
         CASE WHEN u.source_size > 0 THEN floor(u.target / u.source_size) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, source, size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * start + size < 2 * (target - whole * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""

# CRC-32 by the bitwise rule, a byte at a time.
OP6_SQL = f"""
WITH RECURSIVE tab(i, k, v) AS (
  SELECT CAST(i AS UBIGINT), 0, CAST(i AS UBIGINT) FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM tab WHERE k < 8),
t AS (SELECT list(v ORDER BY i) AS c FROM tab WHERE k = 8),
x AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
         xor(list_reduce(list_prepend(4294967295::UBIGINT,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS UBIGINT))),
             lambda a, b: xor(a >> 8, t.c[CAST(xor(a, b) & 255::UBIGINT AS BIGINT) + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM documents, t),
p AS (
  SELECT doc_id, size, text_crc32, row_number() OVER w - 1 AS rank,
         coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER () AS total
  FROM x WINDOW w AS (ORDER BY doc_id NULLS FIRST, size, text_crc32)),
s AS (SELECT *, CAST(((2 * start + size) * {SHARDS}) // (2 * total) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
       CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s
"""

OP9_SQL = rf"""
WITH l AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
b AS (
  SELECT line, min(doc_id) AS first_id FROM l WHERE regexp_matches(line, '[^ \t-\r]')
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (
  SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AND l.doc_id <> b.first_id AS bad FROM l LEFT JOIN b ON l.line = b.line),
g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS kept
  FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM documents d LEFT JOIN g USING (doc_id)
"""


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words a mix with weights 1, 2, 3 and at most three epochs takes of each document."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of near-equal bytes."""
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op9_drop_spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that five sources or more share."""
    out = drop_spread_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), MIN_SITES)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


QUERIES = {"op4_mix_sources": op4_mix_sources, "op6_shard_bytes": op6_shard_bytes, "op9_drop_spread_lines": op9_drop_spread_lines}
ORACLES = {"op4_mix_sources": OP4_SQL, "op6_shard_bytes": OP6_SQL, "op9_drop_spread_lines": OP9_SQL}
