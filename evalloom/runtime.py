"""Session helpers shared by all operators: code shipping, shared storage, size hints."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
_LOCAL_SHARED: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


_BATCH, _BATCH_DEFAULT, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Arrow batches of texts get a smaller default: both sides of the worker's socket hold a batch.
    """
    sc = spark.sparkContext
    if str(spark.conf.get(_BATCH)).rstrip("b") in (str(_BATCH_DEFAULT), "64m"):
        spark.conf.set(_BATCH, str(_BATCH_BYTES))
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="evalloom-code-"), "evalloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"evalloom/{p.relative_to(root)}")
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a new local one where it is unset and the session is local (tests)."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="evalloom-shared-")
    return _LOCAL_SHARED[app]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/evalloom-{uuid.uuid4().hex}/{tag}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage, survives the loss of executors.

    The shuffle files of the plan that made it are released once it is written.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables that materialize() has written; for long sessions, once results are consumed."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for _, path in _WRITTEN:
        p = jvm.org.apache.hadoop.fs.Path(path).getParent()
        p.getFileSystem(conf).delete(p, True)
    _WRITTEN.clear()


@atexit.register
def _release_at_exit() -> None:
    for spark, path in _WRITTEN:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone already
            return


def size_hint(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes behind df, by its leaves (file sizes for file scans)."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        n = int(str(leaves.apply(i).stats().sizeInBytes()))
        total += n if n < 1 << 56 else 1 << 28
    return total


def slices(df: DataFrame, bytes_each: int, least: int = 256, most: int = 1 << 22) -> int:
    """A power of two of hash slices, in proportion to the input."""
    n = least
    while n < most and n * bytes_each < size_hint(df):
        n *= 2
    return n


def sums_before(df: DataFrame, by: list[str], order: str, value: str, name: str, group: int = 1024) -> DataFrame:
    """df with the sum of `value` over the rows of the same `by` with a smaller `order` (a dense non-negative integer).

    Sums run inside groups of consecutive orders and then over the groups, so no task sees more than a `group`-th of one key's rows at once.
    """
    rows = df.withColumn("_g", F.floor(F.col(order) / group).cast("long"))
    inner = rows.withColumn("_i", F.sum(value).over(Window.partitionBy(*by, "_g").orderBy(order)) - F.col(value))
    totals = rows.groupBy(*by, "_g").agg(F.sum(value).alias("_t"))
    before = totals.withColumn("_b", F.sum("_t").over(Window.partitionBy(*by).orderBy("_g")) - F.col("_t")).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_g").alias("_h"), "_b")
    same = F.col("_g") == F.col("_h")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return inner.join(before, same).select(*df.columns, (F.col("_i") + F.col("_b")).alias(name))


def global_index(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with each row's ordinal in the given order: a range partitioning, ranks inside partitions and the partitions' offsets."""
    placed = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))  # a row a partition
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return placed.withColumn("_r", rank).join(offsets, "_p").select(*df.columns, (F.col("_o") + F.col("_r")).alias(name))
