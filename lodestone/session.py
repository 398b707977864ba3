"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lodestone", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def _base_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one of our own with a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="lodestone-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder in the shared scratch area, dropped when the application ends."""
    path = f"{_base_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def finished(spark: SparkSession, path: str, prefix: str, mark: str) -> list[int]:
    """The numbers n of the folders ``path/<prefix>n`` in which ``mark`` was written to its end, ascending."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    numbers = [int(n[len(prefix) :]) for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith(prefix)]
    return sorted(n for n in numbers if fs.exists(_fs(spark, f"{path}/{prefix}{n}/{mark}/_SUCCESS")[1]))


#: With this Spark removes what a query shuffled as soon as it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str = "staged") -> DataFrame:
    """Write ``df`` to the shared scratch area and read it back.

    The result is computed once, survives lost executors, and carries its real
    size, so Spark's own broadcast threshold decides how later joins with it run.
    What was shuffled on the way is removed when it is written, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_path(spark, label)}/data"
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


SMALL_INPUT_PER_CORE = 16 << 20
SPREAD_PARTITION = 256 << 10


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a small input out to all cores before costly work on its rows.

    A small table is often one row group, which one task reads. Inputs that give
    every core its share already come back as they are, without a shuffle.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if cores == 1 or size >= cores * SMALL_INPUT_PER_CORE:
        return df
    return df.repartition(max(1, min(cores, size // SPREAD_PARTITION)), key)
