"""Tables between the jobs of one operator, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, only a local session may go on."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="llm-"))
        top = _LOCAL[0]
    return f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """The rows of ``df``, written once and read back: later jobs don't repeat its work, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = shared_folder(spark)
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that no later job reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/llm-" in f}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input of fewer splits than cores; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ranges_of(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
