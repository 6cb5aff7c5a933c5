"""Written intermediate tables, in the folder that all machines share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting for the removal of a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where that is unset (tests on one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shuffled(df: DataFrame) -> DataFrame:
    """Join ``df`` by a shuffle whatever its size: rows that grow with the documents never pass through the driver."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._millrace_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    # What the shuffles of this write have left on local disks is of no use once the table stands.
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._millrace_path = path
    return table


def filtered(rows: DataFrame, keep) -> DataFrame:
    """The rows that an Arrow function leaves, under names that it need not know: dots in a name are no matter."""
    plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))
    return plain.mapInArrow(keep, plain.schema).toDF(*rows.columns)


def trim() -> None:
    """Give back what a Python worker has freed: it lives on, idle, beside the stages that follow."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
