"""Junctions as a stream: the stateless steps, from parsing to amino-acid ranges. Comparing needs whole clusters, so it stays a batch step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import core
from ..sources.tables import SCHEMAS


def read_junctions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMAS["junctions"]).parquet(folder)


def usable_junctions(stream: DataFrame, domains: DataFrame) -> DataFrame:
    """Parsed junctions of known genes; malformed ones are dropped, so that one bad row doesn't end the stream."""
    return core.usable(core.parse_junctions(stream, on_error="drop"), domains)
