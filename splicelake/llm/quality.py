"""Quality rules with adaptive thresholds, in DataFrame functions only.

Text metrics are computed in the row (no shuffle); KLL sketches per (language, source) are merged into
fences; documents are joined to the fences of their group and filtered.

Defined results: a null or empty text has no words, so every count is 0 and it fails the base rule. Null
lang or source form a group of their own. Repeated rows are kept, one result each. An empty table gives
an empty result. Columns beside those named are carried through `filter_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_id, let, materialise

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Metrics that get a fence; True: also a lower one.
FENCED = {"symbol_ratio": False, "dup_line_ratio": False, "repeat_ratio": False, "mean_word": True}
#: Least width of a fence, so that a group without any spread doesn't reject its first odd document.
MIN_WIDTH = {"symbol_ratio": 0.01, "dup_line_ratio": 0.1, "repeat_ratio": 0.05, "mean_word": 1.0}


def _repeat_words(words: Column, width: int) -> Column:
    """Words inside a window of `width` words that the text holds twice or more."""

    def covered(at: Column) -> Column:
        """Words under the windows that begin at the sorted positions `at`."""
        step = lambda acc, p: F.struct(
            (p + width).alias("upto"), (acc["total"] + width - F.greatest(F.lit(0), acc["upto"] - p)).alias("total")
        )
        return F.aggregate(at, F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total")), step, lambda acc: acc["total"])

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))))
        same = lambda s, x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
            F.get(s, i + 1)["h"] == x["h"], F.lit(False)
        )
        at = let(pairs, lambda s: F.transform(F.filter(s, lambda x, i: same(s, x, i)), lambda x: x["p"]))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(F.sort_array(at)))

    starts = F.sequence(F.lit(1), F.size(words) - (width - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, width)))
    return F.when(F.size(words) <= width, F.lit(0)).otherwise(let(hashes, repeated))


def text_metrics(docs: DataFrame, text: str = "text", window: int = 8) -> DataFrame:
    """`docs` with its text replaced by a struct `m` of counts."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w, window).cast("long").alias("n_repeat_words"),
        ),
    )
    dup = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    n_symbols = F.regexp_count(body, F.lit(SYMBOLS)).cast("long")
    return docs.select(*[c for c in docs.columns if c != text], m.alias("m"), dup.alias("d"), n_symbols.alias("s")).select(
        *[c for c in docs.columns if c != text], "m.*", "d.*", F.col("s").alias("n_symbols")
    )


def _ratios(df: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "symbol_ratio": per("n_symbols", "word_chars"),
            "dup_line_ratio": per("n_dup_lines", "n_lines"),
            "repeat_ratio": per("n_repeat_words", "n_words"),
            "mean_word": per("word_chars", "n_words"),
        }
    )


def fences(metrics: DataFrame, k: int = 800, spread: float = 4.0, min_group: int = 50) -> DataFrame:
    """Limits per (lang, source): quartiles of the group's KLL sketch, `spread` times their distance apart.

    A group below `min_group` documents takes its language's merged sketch. Sketches have a fixed size, are
    built before the shuffle and merged after it, so a hot source costs no more than another.
    """
    group = metrics.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(c, F.lit(k)).alias(f"k_{c}") for c in FENCED]
    )
    wide = group.groupBy("lang").agg(*[F.kll_merge_agg_double(f"k_{c}", F.lit(k)).alias(f"w_{c}") for c in FENCED])
    both = group.join(wide.withColumnRenamed("lang", "w_lang"), F.col("lang").eqNullSafe(F.col("w_lang")))
    cols = [F.col("lang").alias("f_lang"), F.col("source").alias("f_source")]
    for c, below in FENCED.items():
        sketch = F.when(F.col("n") >= min_group, F.col(f"k_{c}")).otherwise(F.col(f"w_{c}"))
        low, high = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        width = F.greatest((high - low) * spread, F.lit(MIN_WIDTH[c]))
        cols += [(high + width).alias(f"hi_{c}"), ((low - width) if below else F.lit(None).cast("double")).alias(f"lo_{c}")]
    return both.select(*cols)


def judge(docs: DataFrame, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """doc_id and its metrics, `base_failed`, and `kept`: not failed and within every fence of its group."""
    metrics = materialise(
        _ratios(text_metrics(docs.select("doc_id", "text", "lang", "source"))).withColumn(
            "base_failed",
            (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        ),
        "quality-metrics",
    )
    limits = fences(metrics.filter(~F.col("base_failed")))
    joined = metrics.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    odd = F.lit(False)
    for c, below in FENCED.items():
        odd |= F.coalesce(F.col(c) > F.col(f"hi_{c}"), F.lit(False))
        if below:
            odd |= F.coalesce(F.col(c) < F.col(f"lo_{c}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~odd).drop(
        "f_lang", "f_source", *[f"{p}_{c}" for c in FENCED for p in ("hi", "lo")]
    )


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that `judge` keeps, with all their columns; rows without an id are judged by no one and go."""
    good = judge(docs).filter("kept").select("doc_id")
    return by_id(docs, good, "left_semi")
