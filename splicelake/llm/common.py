"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.stored import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write `df` once to the shared folder and read it back: lineage is cut and a lost executor loses nothing.

    The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/splicelake/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of `materialise` on which nothing unwritten depends any more."""
    for df in written:
        spark = df.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shape(columns: str, **like: DataFrame) -> StructType:
    """A schema from DDL; a column among `like` has the type of that DataFrame's column of this name."""
    fields = StructType.fromDDL(columns).fields
    return StructType([StructField(f.name, like[f.name].schema[f.name].dataType if f.name in like else f.dataType) for f in fields])


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` bound to a lambda variable, so that it is evaluated once a row
    however often, and in whatever inner lambda, `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def by_id(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """`docs` less or only the rows whose doc_id is in `ids` (left_anti or left_semi); all columns stay as they are."""
    return docs.alias("_docs").join(ids.select("doc_id").distinct().alias("_ids"), F.col("_docs.doc_id") == F.col("_ids.doc_id"), how)
