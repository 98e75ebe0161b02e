"""Source divergence audit: how far the words of each source of a language are from those of the others.

Plain relational: matches of a pattern (runs of letters) are exploded and counted by language, source and term; a term
that its language keeps becomes a row with its sources and their counts, and sums and windows rank what follows from
them. The matches are found and first counted with Arrow: as plain column expressions that was over half of the work.

No row is made for a term that a source lacks: all such terms of a source have the same share, so a pair of sources
starts from the sum in which both lack every kept term, and is corrected for each one's terms (by how many it has how
often) and for those of both. Only the latter are set side by side, which is exact, as all sums are of whole numbers.

No key is one task's: tasks count before they deal out rows, by language and term, and what is summed by language and
sources combines in the map tasks. Shares are looked up before sources are paired, so that no pair is shuffled for it.
Kept terms with their uses are written once, and how often groups have terms.

Defined results: null text, lang and source are read as ''. Each row is a document, so repeated rows count again. A group
without terms, or of a language that keeps none, has its `pair` rows all the same (value 0 where no term is kept); a
language of one source has none. Equal values rank by item, as UTF-8 bytes. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .lexical_search import slices, terms_of

#: What a byte becomes before texts are cut at blanks: letters stay (A-Z lowered), as does whatever isn't ASCII.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
SLICE = 8 << 20
LEAST_DOCUMENTS = 3
SHOWN = 200


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: how often, and in how many documents, a group has a term.

    Tasks find and explode the matches of a slice of texts and count them by group and term before rows leave them,
    dealt by language and term.
    """

    codes = lambda c: np.asarray(c.dictionary_encode().indices).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in slices(b.column(0), SLICE):
                texts, lang, source = (c.slice(s, e - s) for c in b.columns)
                row, terms = terms_of(texts, LETTERS)
                coded = terms.dictionary_encode()
                many = max(1, len(coded.dictionary))
                each, n = np.unique(row.astype(np.int64) * many + np.asarray(coded.indices), return_counts=True)  # by document and term
                pair = codes(lang) * (e - s + 1) + codes(source)
                _, first, group = np.unique(pair, return_index=True, return_inverse=True)
                found, at = np.unique(group[each // many] * many + each % many, return_inverse=True)  # by group and term
                of, term = pa.array(first[found // many]), pa.array(found % many)
                counts = (pa.array(np.bincount(at, w, minlength=len(found)).astype(np.int64)) for w in (n, None))
                yield pa.RecordBatch.from_arrays([lang.take(of), source.take(of), coded.dictionary.take(term), *counts], names=["lang", "source", "term", "n", "docs"])

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("text"), text("lang"), text("source")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(1000000000 * (n + 1) / (total + kept)), exact for any counts."""
    return F.expr(
        f"case when {n} < 9000000000 then 1 + (1000000000 * ({n} + 1)) div ({total} + {kept}) "
        f"else 1 + (cast(1000000000 as decimal(10, 0)) * cast({n} + 1 as decimal(20, 0))) div cast({total} + {kept} as decimal(20, 0)) end"
    )


def excess(p: str, q: str) -> Column:
    """floor((p - q)^2 / q)."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, n_lang, uses (source, n; by source), of the terms that a language has in `least` documents or more.

    Both groupings find their rows in place: the counts come dealt by language and term.
    """
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("uses"))
    return materialise(by_term.filter(F.col("docs") >= least).drop("docs"), "divergence-terms")


def occurring(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lang, source, total, kept, total_lang, none for each group, `none` being the share of a kept term that it lacks;
    and lang, source, n, terms: how many of a group's kept terms it has n times."""
    uses = terms.select("lang", F.explode("uses").alias("use")).select("lang", "use.source", "use.n")
    often = materialise(uses.groupBy("lang", "source", "n").agg(F.count("*").alias("terms")), "divergence-often")
    totals = often.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    by_lang = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n_lang").alias("total_lang"))
    present = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    groups = present.join(totals, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", zero("total"), zero("kept"), zero("total_lang"))
    none = F.when(F.col("kept") > 0, share("0", "total", "greatest(kept, 1)")).otherwise(F.lit(0))
    return materialise(groups.withColumn("none", none), "divergence-groups"), often


def shares(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, term, source, p, q, none for each term that a group has: its share, its language's and that of a term it lacks."""
    uses = terms.select("lang", "term", "n_lang", F.explode("uses").alias("use")).select("lang", "term", "n_lang", "use.source", "use.n")
    return uses.join(groups, ["lang", "source"]).select("lang", "term", "source", share("n", "total", "kept").alias("p"), share("n_lang", "total_lang", "kept").alias("q"), "none")


def apart(terms: DataFrame, groups: DataFrame, often: DataFrame) -> DataFrame:
    """lang, source, item, value: the summed excess of each source's shares over each other one's, 0 if no term is kept.

    As if neither source had any term, then what each one's own terms change in this, then what those of both do: only
    the latter are set side by side, and no row is made for a term that a source lacks.
    """
    side = lambda x: groups.select("lang", "kept", F.col("source").alias(f"source_{x}"), F.col("total").alias(f"total_{x}"), F.col("none").alias(f"none_{x}"))
    a, b = side("a"), side("b").drop("kept", "total_b")
    lacking = F.when(F.col("kept") > 0, F.col("kept") * excess("none_a", "none_b")).otherwise(F.lit(0))
    neither = a.join(b, "lang").filter("source_a != source_b").select("lang", "source_a", "source_b", lacking.alias("value"))

    own = often.withColumnRenamed("source", "source_a").join(a, ["lang", "source_a"]).withColumn("p_a", share("n", "total_a", "kept")).join(b, "lang").filter("source_a != source_b")
    ab, ba = excess("p_a", "none_b") - excess("none_a", "none_b"), excess("none_b", "p_a") - excess("none_b", "none_a")
    own = own.groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("terms") * ab).alias("ab"), F.sum(F.col("terms") * ba).alias("ba"))

    several = shares(terms.filter(F.size("uses") > 1), groups).groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "none"))).alias("uses"))
    use = lambda x: [F.col(f"use.{c}").alias(f"{c}_{x}") for c in ("source", "p", "none")]
    one = several.select("lang", "uses", F.posexplode("uses").alias("at", "use")).filter("at + 1 < size(uses)")
    both = one.select("lang", *use("a"), F.explode(F.slice("uses", F.col("at") + 2, F.size("uses"))).alias("use")).select("lang", "source_a", "p_a", "none_a", *use("b"))
    more = lambda x, y: excess(f"p_{x}", f"p_{y}") - excess(f"p_{x}", f"none_{y}") - excess(f"none_{x}", f"p_{y}") + excess(f"none_{x}", f"none_{y}")
    both = both.groupBy("lang", "source_a", "source_b").agg(F.sum(more("a", "b")).alias("ab"), F.sum(more("b", "a")).alias("ba"))

    ways = F.explode(F.array(F.struct("source_a", "source_b", F.col("ab").alias("value")), F.struct(F.col("source_b").alias("source_a"), F.col("source_a").alias("source_b"), F.col("ba").alias("value"))))
    changes = own.unionByName(both).select("lang", ways.alias("way")).select("lang", "way.*")
    return neither.unionByName(changes).groupBy("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item")).agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, shown: int = SHOWN) -> DataFrame:
    """lang, source, part, item, value, rank, of documents (text, lang, source).

    `pair`: each other source of the language, by the summed excess of this one's shares over its; all of them.
    `term`: terms that this source uses more than its language does, by that excess; the first `shown`.
    """
    terms = kept_terms(docs, least)
    groups, often = occurring(docs, terms)
    over = shares(terms, groups).filter("p > q").select("lang", "source", F.col("term").alias("item"), excess("p", "q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shape = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return shape(apart(terms, groups, often), "pair").unionByName(shape(over, "term").filter(F.col("rank") <= shown))
