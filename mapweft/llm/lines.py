"""Cross-site line removal: HyperLogLog sketches of the sites of each line. JVM only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweft.session import cut

# A sketch of 2^10 registers has a standard error of 3.3 %.
LG_K = 10
ERROR = 1.04 / 2 ** (LG_K / 2)
# Cross-site lines up to this many (24 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_LINES = 500_000


def fresh_name(columns: list[str], name: str) -> str:
    """A column name that none of the columns has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _key(line):
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _lines(text_col: str):
    return F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")


def spread_lines(lines: DataFrame, min_sites: int, margin: float = 5.0) -> DataFrame:
    """Keys that occur on at least `min_sites` sites, with the smallest id that has them.

    `lines` has (doc_id, site, key). Sketches of a key's sites are built before the
    shuffle and merged after it, so a line that every site has moves as sketches only.
    A key whose estimate is over `margin` standard errors off the threshold is decided
    by it; the keys in between get an exact distinct count. Null sites count as none.
    """
    pairs = cut(lines.groupBy("key", "site").agg(F.min("doc_id").alias("first_id")))
    estimate = (
        pairs.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("first_id").alias("first_id"))
        .select("key", "first_id", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    slack = max(1.0, margin * ERROR * min_sites)
    estimate = cut(estimate.where(F.col("sites") >= min_sites - slack))
    sure = estimate.where(F.col("sites") > min_sites + slack).select("key", "first_id")
    near = estimate.where(F.col("sites") <= min_sites + slack).select("key")
    # The count leaves null sites out; the smallest id is that of all rows, as in the sure ones.
    exact = (
        pairs.join(near, "key", "left_semi").groupBy("key").agg(F.count("site").alias("sites"), F.min("first_id").alias("first_id"))
        .where(F.col("sites") >= min_sites).select("key", "first_id")
    )
    return sure.unionByName(exact)


def drop_spread_lines(
    docs: DataFrame, min_sites: int = 5, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source",
) -> DataFrame:
    """Remove lines that stand on `min_sites` sites or more, but for their first document.

    A line is what stands between two newlines, compared as it is; lines of ASCII white
    space only always stay. The document with the smallest id keeps its copy, so that a
    text copied over many sites survives once; it may be one without a site. Returns the
    input's columns with the text shortened, and n_lines and n_removed.

    Null text stays null (0 lines). A null site is no site. Rows with a null id never
    keep a copy. Repeated rows are treated alike. Empty input: no rows. Input columns
    named n_lines or n_removed are replaced.
    """
    frame = docs.drop("n_lines", "n_removed")
    lines = cut(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(site_col).alias("site"), F.explode(F.array_distinct(_lines(text_col))).alias("line"),
        ).where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc_id", "site", _key(F.col("line")).alias("key"))
    )
    bad = cut(spread_lines(lines, min_sites))
    if bad.count() <= BROADCAST_LINES:
        bad = F.broadcast(bad)
    own, gone, kept = (fresh_name(frame.columns, c) for c in ("_id", "_bad", "_kept"))
    hits = (
        lines.join(bad, "key").where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
        .groupBy("doc_id").agg(F.collect_set("key").alias(gone)).withColumnRenamed("doc_id", own)
    )
    joined = frame.join(hits, frame[id_col].eqNullSafe(hits[own]), "left")
    left = F.when(F.col(gone).isNull(), _lines(text_col)).otherwise(
        F.filter(_lines(text_col), lambda x: ~F.array_contains(F.col(gone), _key(x)))
    )
    names = [F.col(c) if c != text_col else F.when(F.col(c).isNotNull(), F.array_join(kept, "\n")).alias(c) for c in frame.columns]
    n = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(_lines(text_col)))
    return joined.withColumn(kept, left).select(
        *names, n.cast("long").alias("n_lines"),
        (n - F.when(F.col(text_col).isNull(), 0).otherwise(F.size(kept))).cast("long").alias("n_removed"),
    )
