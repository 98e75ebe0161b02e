"""Joins of places: intervals that share a point, and places within a tolerance, as joins by equality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import overlaps

#: Widths of bins: on the genome, and on the amino-acid axis.
GENOME_BIN = 16_384
PROTEIN_BIN = 256


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], spans: Sequence[str], width: int) -> DataFrame:
    """Pairs of equal `keys` whose closed intervals share a point. `spans`: start and end of `left`, then of `right`; but
    for the keys the columns must have different names. An interval with its end before its start shares points with
    those that hold both.

    Both sides go to each bin that they touch, and are joined by keys and bin, so that the rows of one key are dealt over
    many tasks. A pair is taken in the first bin that both touch: once. Null keys and places have no pair.
    """

    def dealt(df: DataFrame, start: str, end: str) -> DataFrame:
        at = lambda c: F.floor(c / width).cast("bigint")
        low, high = at(F.least(start, end)), at(F.greatest(start, end))
        known = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull())
        return known.withColumn("_bin", F.explode(F.sequence(low, high)))

    ls, le, rs, re = spans
    pairs = dealt(left, ls, le).join(dealt(right, rs, re), [*keys, "_bin"])
    first = F.floor(F.greatest(F.least(ls, le), F.least(rs, re)) / width)
    return pairs.filter((F.col("_bin") == first) & overlaps(F.col(ls), F.col(le), F.col(rs), F.col(re))).drop("_bin")


def near_join(left: DataFrame, right: DataFrame, keys: Sequence[str], a: str, b: str, more: Column | None = None, by: int = 1) -> DataFrame:
    """Pairs of equal `keys` with |a - b| <= `by` (`a` of `left`, `b` of `right`), and `more` if given.

    The left side goes to each place near its own, so that the place is a key of a hash join: a row meets those near it
    alone, not all of its keys.
    """
    spread = left.filter(F.col(a).isNotNull()).withColumn("_place", F.explode(F.sequence(F.col(a) - by, F.col(a) + by)))
    pairs = spread.join(right.withColumn("_place", F.col(b)), [*keys, "_place"])
    return (pairs if more is None else pairs.filter(more)).drop("_place")


def transcript_join(junctions: DataFrame, exons: DataFrame, width: int = GENOME_BIN, more: DataFrame | None = None) -> DataFrame:
    """The rows of `junctions` (gene, js, je, ...) with each transcript of their gene whose extent, widened by 1, they
    share a point with: tx and exons, a list of structs of the other columns of `exons` (gene, tx, gs, ge, ...).

    A transcript's exons come in one row, so that what is asked of all of them is an expression of the pair and nothing
    is shuffled behind the join. `more` (tx, ...) has further columns of transcripts; those that it lacks have nulls.
    """
    fields = [c for c in exons.columns if c not in ("gene", "tx")]
    own = exons.groupBy("gene", "tx").agg(
        F.collect_list(F.struct(*fields)).alias("exons"), (F.min(F.least("gs", "ge")) - 1).alias("_low"), (F.max(F.greatest("gs", "ge")) + 1).alias("_high"),
    )
    own = own if more is None else own.join(more, "tx", "left")
    return overlap_join(junctions, own, ["gene"], ("js", "je", "_low", "_high"), width).drop("_low", "_high")
