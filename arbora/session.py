"""Session helpers: scratch tables in the shared folder, and cutting of lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_scratch: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, shared by driver and executors; a temporary one only
    where that is unset and driver and executors are one process, as in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local_scratch:
            _local_scratch.append("file://" + tempfile.mkdtemp(prefix="arbora-"))
        root = _local_scratch[0]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; the JVM deletes it when it ends."""
    path = f"{scratch_root(spark)}/arbora-{uuid.uuid4().hex}-{name}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, name: str, free: bool = False, dictionary: int = 1 << 20) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, so a lost executor costs no
    recomputation of earlier steps. With ``free``, shuffle files of finished steps are released. ``dictionary``
    bounds the bytes of the dictionary of a column chunk."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.option("compression", "zstd").option("parquet.dictionary.page.size", str(dictionary)).parquet(path)
    del df
    if free:
        release(spark)
    out = spark.read.schema(schema).parquet(path)
    out._staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of staged frames that nothing will read again."""
    for df in frames:
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._staged_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that no live frame refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
