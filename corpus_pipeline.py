"""From raw documents to token ids: five stages, each one operator at work.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of the documents. Each works on all that the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweft.llm import bpe, toxicity
from mapweft.llm.jaccard import similar_documents
from mapweft.llm.lines import drop_spread_lines, fresh_name
from mapweft.llm.mixing import mix
from mapweft.session import cut

TOXIC = 0.3
MIN_SITES = 5
SIMILAR_PERCENT = 80
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3

# The classifier, word hashes and encoder have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below the threshold.

    Null and empty texts are scored as the empty text; repeated rows are scored alike.
    Without documents or labels nothing is learnt and nothing goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out()))
    toxic = fresh_name(docs.columns, "_toxic")
    return toxicity.score(docs, model, out_col=toxic).where(F.col(toxic) < TOXIC).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many sources share, but for their first copy.

    Null texts stay null, lines of white space stay, a null source is none. Documents that
    lose lines get a new n_chars, if they have one; input columns n_lines and n_removed
    keep their values.
    """
    lines = fresh_name(docs.columns, "_lines")
    counted = docs.withColumnsRenamed({c: f"{lines}_{c}" for c in ("n_lines", "n_removed")})
    out = drop_spread_lines(counted, MIN_SITES)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    back = out.drop("n_lines", "n_removed").withColumnsRenamed({f"{lines}_{c}": c for c in ("n_lines", "n_removed")})
    return back.select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the one with the smallest id.

    Rows are told apart by id and text, so a near-copy goes even if another row has its
    id; of rows with the same id and text one stays. Null ids are the largest. Texts
    without words are similar to nothing and stay.
    """
    key, own, same = (fresh_name(docs.columns, c) for c in ("_key", "_id", "_same"))
    kept = similar_documents(docs, SIMILAR_PERCENT).where("kept").select(F.col("doc_id").alias(own), F.col("text_key").alias(same)).distinct()
    wordless = F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    keyed = docs.where(~wordless).withColumn(key, F.xxhash64("text"))
    chosen = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(key) == F.col(same)), "left_semi")
    return chosen.dropDuplicates(["doc_id", key]).select(*docs.columns).unionByName(docs.where(wordless))


def repeat_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each repetition, none for those left out.

    Rows with the same id, text and source stand for each other: as many rows come out as
    the mix takes of all of them. Texts without words, null ones too, weigh nothing and are
    left out.
    """
    key, own, same, place, times, copy = (fresh_name(docs.columns, c) for c in ("_key", "_id", "_text", "_source", "_times", "_copy"))
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.select("doc_id", "text", "source", text.alias(same))
    taken = mix(keyed, WEIGHTS, MAX_EPOCHS, keep=(same,)).where("taken > 0").select(
        F.col("doc_id").alias(own), same, F.col("source").alias(place), (F.col("taken") / F.col("size")).cast("int").alias(times)
    )
    counts = taken.groupBy(own, same, place).agg(F.sum(times).cast("int").alias(times))
    once = docs.withColumn(key, text).dropDuplicates(["doc_id", key, "source"])
    return (
        once.join(counts, F.col("doc_id").eqNullSafe(F.col(own)) & (F.col(key) == F.col(same)) & F.col("source").eqNullSafe(F.col(place)))
        .withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*docs.columns)
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the text decoded from them.

    Null texts have no ids; repeated rows, as the mix makes them, are encoded each.
    """
    return bpe.encode_documents(docs, outputs=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", repeat_to_weights),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; what each keeps is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if i < len(STAGES) - 1 else docs
    return docs
