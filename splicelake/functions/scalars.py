"""Scalar expressions: names, coordinates, labels, number formats. All plain column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of name columns, of label columns, and the layout's constants.
NAME_COLUMNS = ("cdd", "pfam", "smart", "tigr", "interpro", "CDD_id")
LABEL_COLUMNS = ("interpro", "pfam", "cdd", "smart")
LABEL_LENGTH = 14
HEX_COLORS = (
    "#FF4A46", "#1BE177", "#00CCFF", "#A30059", "#FFB500", "#006FA6", "#4FC601", "#FFDBE5",
    "#D16100", "#00C2A0", "#A079BF", "#C0B9B2", "#CC0744", "#549E79", "#B79762", "#B903AA",
    "#00846F", "#FF90C9", "#0AA6D8", "#F4ABAA", "#A3F3AB", "#00C6C8", "#EA8B66", "#BEC459",
    "#AA5199", "#0089A3", "#EEC3FF", "#8FB0FF", "#004D43", "#F4D749", "#997D87", "#3B5DFF",
    "#FF2F80", "#6B7900", "#FFAA92", "#A1C299", "#885578", "#B77B68", "#FAD09F", "#456D75",
    "#FF8A9A", "#0086ED", "#D157A0", "#00A6AA", "#B4A8BD", "#FF913F", "#636375", "#A3C8C9",
)
PALETTE_SIZE = len(HEX_COLORS)
STRIPS = 80


def stripped(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def present(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (stripped(c) != "")


def valid(c: Column) -> Column:
    """Present, and not the text nan."""
    return present(c) & (stripped(c) != "nan")


def first_valid_name(null_name_literal: str | None = None) -> Column:
    """The first valid one of the name columns, untrimmed; optionally with a text in place of null, as older pandas had it."""
    cols = [F.col(c) if null_name_literal is None else F.coalesce(F.col(c), F.lit(null_name_literal)) for c in NAME_COLUMNS]
    return F.coalesce(*[F.when(valid(c), c) for c in cols])


def without_version(c: Column) -> Column:
    return F.split_part(c, F.lit("."), F.lit(1))


def to_amino_acid(c: str) -> Column:
    """Nucleotide to amino-acid coordinate, truncated towards zero; null counts as non-coding (0)."""
    return F.expr(f"coalesce(cast({c} as bigint), 0) div 3")


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals share a point."""
    return (a_start <= b_end) & (a_end >= b_start)


def near(a: Column, b: Column, by: int = 1) -> Column:
    return F.abs(a - b) <= by


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def negative_strand(c: Column) -> Column:
    text = F.lower(stripped(c))
    return F.coalesce(text.startswith("-") | (text == "minus"), F.lit(False))


def domain_label(compact: Column, length: int = LABEL_LENGTH) -> Column:
    """The first distinct valid name, cut to `length`; a star if cut, if there are more names, or if compact."""
    names = F.array_distinct(F.filter(F.array(*[stripped(F.col(c)) for c in LABEL_COLUMNS]), lambda x: x.isNotNull() & (x != "") & (F.lower(x) != "nan")))
    first = F.get(names, F.lit(0))
    star = compact | (F.size(names) > 1) | (F.length(first) > length)
    return F.when(F.size(names) > 0, F.concat(F.substring(first, 1, length), F.when(star, F.lit("*")).otherwise(F.lit(""))))


def with_commas(c: Column) -> Column:
    return F.format_number(c.cast("bigint"), 0)


def _four_digits(v: Column) -> Column:
    """Four significant digits without trailing zeros, for absolute values from 1 on; ties of the decimal text go half to even."""
    places = F.greatest(F.lit(0), F.lit(3) - F.floor(F.log10(F.abs(v))).cast("int"))
    r = F.when(places == 3, F.bround(v, 3)).when(places == 2, F.bround(v, 2)).when(places == 1, F.bround(v, 1)).otherwise(F.bround(v, 0))
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", r), "0+$", ""), r"\.$", "")


def axis_number(c: Column) -> Column:
    """Millions and thousands with four digits and M or K, else the rounded number (half to even)."""
    v = c.cast("double")
    return (
        F.when(F.abs(v) >= 1_000_000, F.concat(_four_digits(v / 1_000_000), F.lit("M")))
        .when(F.abs(v) >= 1_000, F.concat(_four_digits(v / 1_000), F.lit("K")))
        .otherwise(F.bround(v, 0).cast("bigint").cast("string"))
    )


def palette(c: Column) -> Column:
    return F.pmod(c, F.lit(PALETTE_SIZE))
