"""Tables in the folder that driver and executors share, and Arrow batches that fit whole texts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a temporary one only where none is set and everything runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='varve-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def keep(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a scratch table and return a reader of it. The folder goes when the JVM ends."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/varve-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Texts in one Arrow batch; a batch is held twice outside the heap.
TEXT_ROWS = 512


def text_batches(spark: SparkSession) -> None:
    """Make the session's Arrow batches fit rows with whole texts, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_ROWS:
        spark.conf.set(name, str(TEXT_ROWS))
