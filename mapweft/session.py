"""Session helpers: settings, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only while Spark's own estimate of it stays under this.
BROADCAST_BYTES = 64 << 20
# Below this estimate no single key can outgrow a task, so hot keys are not counted.
SKEW_CHECK_BYTES = 1 << 30
# Input that one task of a dealt-out table stands for, so that its memory does not grow with the input.
TASK_BYTES, LEAST_TASK_BYTES = 4 << 20, 512 << 10


def local_session(cores: int | str = 8, app: str = "mapweft") -> SparkSession:
    """A local session for tests and benchmarks. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to reliable storage and return it without its lineage.

    A checkpoint keeps the constraints its plan inferred, and in a loop they
    multiply until planning never ends, so they are not inferred here.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    key = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(key, "true")
    spark.conf.set(key, "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set(key, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path beside the checkpoints, which every machine can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame) -> DataFrame:
    """Write `df` as a table beside the checkpoints and return it as read back.

    Like `cut`, for loops of joins: a checkpoint keeps the size that Catalyst guessed, and
    in a loop the guesses multiply until they are numbers of thousands of digits. Files
    have the size they have, so small tables are also seen to be small.
    """
    spark = df.sparkSession
    path = shared_path(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables from `store`, once all that was derived from them is stored itself."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def _whole(size) -> int:
    return size if isinstance(size, int) else int(str(size))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan. No job runs."""
    return _whole(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and tables a plan reads. No job runs.

    Join estimates multiply their sides, so the sum over the leaves is the
    better measure of whether one key could overload a task.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(_whole(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def fits_one_task(df: DataFrame) -> bool:
    """Whether even a key that held every row would be an ordinary task."""
    return input_bytes(df) < SKEW_CHECK_BYTES


def tasks_for(*inputs: DataFrame) -> int:
    """Tasks for rows of these inputs: as many more as they are larger. A number that is asked for is not coalesced."""
    size = sum(input_bytes(df) for df in inputs)
    spark = inputs[0].sparkSession
    if size >= 1 << 50:  # rows without files have no size
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // TASK_BYTES), min(spark.sparkContext.defaultParallelism, -(-size // LEAST_TASK_BYTES)))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the estimate allows it; otherwise leave the plan to Spark."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
