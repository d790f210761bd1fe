"""Structured Streaming forms: rates over event time, folded edits, refreshed extracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.edits import merge_fold
from ..session import cut, shared_path

BUCKETS = 64


def _hadoop(spark: SparkSession, path: str):
    """The path and the file system it lies on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    where, fs = _hadoop(spark, path)
    return fs.exists(where)


def read_table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream: one file in the folder, or a folder of parts."""
    table = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(table).schema)
    where, fs = _hadoop(spark, table)
    if fs.getFileStatus(where).isDirectory():
        return reader.parquet(table)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def trailing_rate(events: DataFrame, size: str = "4 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and value sums per sliding window. The same plan serves batch and stream."""
    seen = events
    if events.isStreaming:
        # Watermarks need an instant; the window start goes back to the wall clock below.
        seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return seen.groupBy(F.window("ts", size, slide).alias("win"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")) \
        .select(F.col("win.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """What a stream has said when all that lies there now is read, as a table beside the checkpoints."""
    spark = stream.sparkSession
    out, marks = shared_path(spark, "stream"), shared_path(spark, "progress")

    def keep(batch: DataFrame, _number: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    schema = stream.schema
    return spark.read.schema(schema).parquet(out) if path_exists(spark, out) else spark.createDataFrame([], schema)


class KeyedState:
    """A table of the latest value per key, in hash buckets with versions.

    A batch reads and rewrites only the buckets that its keys fall in. The version a
    bucket has after each batch stands in that batch's manifest, which is written last:
    a batch that failed in the middle is done again from the manifest before it, and
    gives the same files. Versions that neither of the last two manifests names go.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifest(self, number: int) -> dict[int, int]:
        """Version of each bucket after a batch; at most one entry a bucket."""
        path = f"{self.path}/manifest/{number}"
        if number < 0 or not path_exists(self.spark, f"{path}/_SUCCESS"):
            return {}
        return {r.bucket: r.version for r in self.spark.read.parquet(path).collect()}

    def last(self) -> int:
        """Number of the last batch that was finished, -1 if none was."""
        where, fs = _hadoop(self.spark, f"{self.path}/manifest")
        if not fs.exists(where):
            return -1
        done = [int(s.getPath().getName()) for s in fs.listStatus(where)]
        return max((n for n in done if path_exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS")), default=-1)

    def _parts(self, versions: dict[int, int], like: DataFrame) -> DataFrame:
        paths = [f"{self.path}/state/{v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(like.schema).parquet(*paths) if paths else like.limit(0)

    def read(self, like: DataFrame, number: int | None = None) -> DataFrame:
        """The whole state after a batch, by default the last one."""
        return self._parts(self.manifest(self.last() if number is None else number), like)

    def apply(self, batch: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Fold a batch into the buckets it touches."""
        before = self.manifest(number - 1)
        touched = {r.b for r in batch.select(self._bucket().alias("b")).distinct().collect()}
        if touched:
            state = self._parts({b: v for b, v in before.items() if b in touched}, batch)
            merge(state, batch).withColumn("bucket", self._bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/state/{number}")
        after = before | dict.fromkeys(touched, number)
        rows = self.spark.createDataFrame(sorted(after.items()), "bucket int, version int")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{number}")
        self._prune(number, set(before.values()) | set(after.values()))

    def _prune(self, number: int, used: set[int]) -> None:
        for folder, keep in (("state", used | {number}), ("manifest", {number, number - 1})):
            where, fs = _hadoop(self.spark, f"{self.path}/{folder}")
            for status in fs.listStatus(where) if fs.exists(where) else []:
                name = status.getPath().getName()
                if name.isdigit() and int(name) < number and int(name) not in keep:
                    fs.delete(status.getPath(), True)


def fold_edits_stream(patches: DataFrame, keys: list[str], state_path: str, checkpoint: str, buckets: int = BUCKETS):
    """Fold a patch stream (keys, value, seq) into a keyed state.

    Clears stay in the state as nulls with their sequence number, so a late older patch
    cannot bring a value back.
    """
    def fold(batch: DataFrame, number: int) -> None:
        narrow = batch.select(*keys, "value", "seq")
        KeyedState(batch.sparkSession, state_path, keys, buckets).apply(narrow, number, lambda state, new: merge_fold(state, new, keys))

    return patches.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folded_edits(spark: SparkSession, state_path: str, keys: list[str], like: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The values a fold stream has come to; cleared ones are left out."""
    return KeyedState(spark, state_path, keys, buckets).read(like.select(*keys, "value", "seq")).where("value IS NOT NULL")


def latest_extracts(rows: DataFrame, region: str, day: str) -> DataFrame:
    """Rows of each region's newest extract; the older ones are replaced whole."""
    newest = rows.groupBy(region).agg(F.max(day).alias(day))
    return rows.join(newest, [region, day], "left_semi")


def refresh_extract_stream(extracts: DataFrame, path: str, checkpoint: str, region: str = "region", day: str = "day"):
    """Overwrite a region's partition whenever an extract arrives that is no older than the stored one.

    Only the days of the regions that a batch names are looked up.
    """
    def replace(batch: DataFrame, _number: int) -> None:
        spark = batch.sparkSession
        newest = batch.groupBy(region).agg(F.max(day).alias(day))
        if path_exists(spark, path):
            stored = spark.read.schema(batch.schema).parquet(path)
            had = stored.join(newest.select(region), region, "left_semi").groupBy(region).agg(F.max(day).alias("_had"))
            newest = newest.join(had, region, "left").where(F.col("_had").isNull() | (F.col(day) >= F.col("_had"))).select(region, day)
        due = cut(batch.join(newest, [region, day], "left_semi"))
        if not due.isEmpty():
            due.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(region).parquet(path)

    return extracts.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
