"""Row numbers by key in two levels, so that a key with very many rows is numbered by many tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, runs: int | None = None) -> DataFrame:
    """`df` with `name`: 1, 2, ... in each of `keys`, by `order` (nulls first), which should tell its rows apart.

    Rows are dealt by ranges of keys and order, as `runs` runs (the session's shuffle partitions if None), each of which
    is sorted, numbered by itself as it goes by, and written. A key goes on from the run before only as a run's first
    one, so that what is added to its numbers is a row a run at most, and the rows are shuffled once. This runs a job when
    the plan is made.
    """
    n = runs or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_run", F.spark_partition_id())
    at = [df.columns.index(k) for k in keys]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            fresh = np.zeros(b.num_rows, bool)
            for k in at:  # null is a key as any other
                c = b.column(k)
                here, prior = c.slice(1), c.slice(0, b.num_rows - 1)
                differ = pc.fill_null(pc.not_equal(here, prior), False).to_numpy(zero_copy_only=False)
                fresh[1:] |= differ | (here.is_null().to_numpy(zero_copy_only=False) != prior.is_null().to_numpy(zero_copy_only=False))
            first = [b.column(k)[0].as_py() for k in at]
            places = np.arange(b.num_rows, dtype=np.int64)
            starts = np.maximum.accumulate(np.where(fresh, places, 0))
            numbers = places - starts + 1
            if first == last:
                numbers[starts == 0] += before
            last, before = [b.column(k)[b.num_rows - 1].as_py() for k in at], int(numbers[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers)], names=[*b.schema.names, "_here"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    # Written, so that a run holds the same rows whenever it is read.
    dealt = stored(rows.mapInArrow(number, f"{kind}, _here bigint"), name)
    edges = dealt.groupBy("_run").agg(F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys, "_here")).alias("last"))
    ends = edges.select(F.col("_run").alias("_past"), *[F.col(f"last.{k}").alias(k) for k in keys], F.col("last._here").alias("_n"))
    starts = edges.select("_run", *[F.col(f"first.{k}").alias(k) for k in keys])
    # One row a run: the rows of its first key in the runs before it.
    at_run = Window.partitionBy(*keys).orderBy("_run", "_start").rowsBetween(Window.unboundedPreceding, -1)
    both = starts.withColumns({"_n": F.lit(0).cast("bigint"), "_start": F.lit(0)}).unionByName(ends.select(F.col("_past").alias("_run"), *keys, "_n", F.lit(1).alias("_start")))
    more = both.withColumn("_before", F.sum("_n").over(at_run)).filter("_start = 0 and _before > 0").select("_run", *keys, "_before")
    same = F.col("a._run") == F.col("b._run")
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    both = dealt.alias("a").join(F.broadcast(more).alias("b"), same, "left")
    return both.select(*[F.col(f"a.{c}") for c in df.columns], (F.col("_here") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name))
