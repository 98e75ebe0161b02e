"""Steps that several later steps read are written once, to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, which only a local master can share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="splicelake-"))
    return _own[0]


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df`, written and read again; the files go when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/splicelake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def exists(written: DataFrame) -> bool:
    """Whether the files of a table of `stored` are there still."""
    spark = written.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(written._written)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
