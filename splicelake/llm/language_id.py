"""Language identification by bit-sliced Bloom filters of n-grams.

A slot of the filter is a bit mask of languages, as many 64-bit words as they need. An n-gram of a language
sets that language's bit in its k slots, so the conjunction of the k slots of an n-gram is the set of all languages that (perhaps) contain it.
A text's n-grams are looked up at once; per language the hits are counted, less the share that false
positives give at that language's fill, and the best corrected share decides.

An n-gram counts as contained by a language if its rate there is at least `share` of its highest rate in any
language, so that stray foreign words in a training text don't blur the filter. Rates come from all training
documents; n-grams are counted before the shuffle, batch by batch. The number of slots follows the n-grams, so
that at most about half are set. The filter is made and broadcast in parts of at most `PART_BYTES`; an n-gram's
hash names its part, and a text's hits are added up over the parts (of a small filter there is one).

Defined results: a null text or one without letters is `und`, score 0; so is every text if there is no
training text at all. Ties go to the language first in alphabetical order. Repeated rows give a row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Slots at least; and bytes of a part at most.
SLOTS = 1 << 20
PART_BYTES = 1 << 25
PROBES = 3
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[3]
    return (h ^ (h >> np.uint64(29))) * _M[0]


_LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """Hashes of the 3-character windows of the lower-cased text with all but letters as one space, words padded."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[codes]
    if not letter.any():
        return np.empty(0, np.uint64)
    c = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.uint64)
    c = c[np.concatenate(([True], (c[1:] != 0) | (c[:-1] != 0)))]  # runs of what isn't a letter shrink to one
    if len(c) < 3:
        return np.empty(0, np.uint64)
    return _mix(c[:-2] * _M[0] + c[1:-1] * _M[1] + c[2:] * _M[2])


def _slots(g: np.ndarray, size: int) -> list[np.ndarray]:
    a, b = g & np.uint64(0xFFFFFFFF), g >> np.uint64(32)
    return [((a + np.uint64(k) * (b | np.uint64(1))) % np.uint64(size)).astype(np.int64) for k in range(PROBES)]


def counts(train: DataFrame) -> DataFrame:
    """gram, lang, n over the training documents; a task holds the counts of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                if (g := grams(text.as_py())).size:
                    by.setdefault(lang, []).append(g)
            for lang, parts in by.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array([lang] * len(g), pa.string()), pa.array(n.astype(np.int64))], names=["gram", "lang", "n"])

    some = train.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return some.select("text", "lang").mapInArrow(run, "gram long, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def part_of(g: np.ndarray, parts: int) -> np.ndarray:
    return (_mix(g) >> np.uint64(40)).astype(np.int64) % parts


class Part:
    """A part of the filter: slots x words of 64 languages each, and each language's rate of false hits in it."""

    def __init__(self, slots: np.ndarray, n_langs: int) -> None:
        self.slots = slots
        fill = [np.count_nonzero(slots[:, i >> 6] & np.uint64(1 << (i & 63))) / len(slots) for i in range(n_langs)]
        self.false = np.array(fill) ** PROBES

    def hits(self, g: np.ndarray) -> np.ndarray:
        """Per language the n-grams contained, less those that false positives give."""
        out = np.zeros(len(self.false))
        if g.size:
            masks = np.bitwise_and.reduce([self.slots[s] for s in _slots(g, len(self.slots))])
            for word in range(masks.shape[1]):
                kinds, n = np.unique(masks[:, word], return_counts=True)
                for i in range(64 * word, min(64 * (word + 1), len(out))):
                    out[i] = n[(kinds >> np.uint64(i & 63)) & np.uint64(1) == 1].sum()
        return (out - self.false * g.size) / np.maximum(1e-9, 1 - self.false)


class Filter:
    """The learned filter: languages by bit, the parts' number, and a way to make a part."""

    def __init__(self, langs: list[str], parts: int, make: Callable[[int], Part]) -> None:
        self.langs, self.parts, self.make = langs, parts, make


def decide(langs: list[str], hits: np.ndarray | list[float] | None, n: int) -> tuple[str, float]:
    """The language of a text of `n` n-grams with these hits."""
    if not n or not langs:
        return "und", 0.0
    share = np.clip(np.asarray(hits) / n, 0, 1)
    best = int(np.argmax(share))
    return langs[best], float(share[best])


def learn(train: DataFrame, share: float = 0.2, least: int = 3, slots: int = SLOTS, part_bytes: int = PART_BYTES) -> Filter:
    """A filter from the texts and languages of `train`. The languages' names are the only thing to grow on the driver."""
    seen = materialise(counts(train), "language-grams")
    totals = sorted((r["lang"], r["total"]) for r in seen.groupBy("lang").agg(F.sum("n").alias("total")).collect())
    langs = [lang for lang, _ in totals]
    table = F.broadcast(seen.sparkSession.createDataFrame([(lang, n, k) for k, (lang, n) in enumerate(totals)], "lang string, total long, bit int"))
    rates = seen.join(table, "lang").withColumn("rate", F.col("n") / F.col("total"))
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("bit", "rate", "n")).alias("per"))
    own = top.select("gram", F.explode(F.filter("per", lambda x: (x["rate"] >= F.col("top") * share) & (x["n"] >= least))).alias("x")).select("gram", F.col("x.bit").alias("bit"))
    own = materialise(own, "language-own")
    words = max(1, -(-len(langs) // 64))
    per_part = 1 << max(6, int(math.log2(max(1, part_bytes // (8 * words)))))
    need = max(slots, 2 * PROBES * own.select("gram").distinct().count())
    parts = -(-need // per_part)
    size = per_part if parts > 1 else 1 << math.ceil(math.log2(need))
    size = min(size, per_part)

    def make(part: int) -> Part:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g, bit = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy().astype(np.int64)
                mine = part_of(g, parts) == part
                g, bit = g[mine], bit[mine]
                at = np.concatenate(_slots(g, size)) if g.size else np.empty(0, np.int64)
                mask = np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(bit >> 6, PROBES).astype(np.int32)), pa.array(np.tile(mask, PROBES))], names=["at", "word", "mask"])

        placed = own.mapInArrow(place, "at long, word int, mask long").groupBy("at", "word").agg(F.bit_or("mask").alias("mask"))
        got, filled = placed.toArrow(), np.zeros((size, words), np.uint64)  # a part's slots at most
        filled[got.column("at").to_numpy(), got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
        return Part(filled, len(langs))

    return Filter(langs, parts, make)


PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """doc_id, lang_pred, score for every row of `docs`; only its text is looked at."""
    langs, parts, context = model.langs, model.parts, docs.sparkSession.sparkContext
    if parts == 1:
        sent = context.broadcast(model.make(0))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = sent.value
            for b in batches:
                found = [grams(x.as_py() or "") for x in b.column(1)]
                got = [decide(langs, part.hits(g), g.size) for g in found]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], schema=PREDICTED)

        return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")

    rows = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")), "language-rows")

    def pass_of(part: int) -> DataFrame:
        sent = context.broadcast(model.make(part))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [grams(x.as_py() or "") for x in b.column(1)]
                hits = [sent.value.hits(g[part_of(g, parts) == part]) for g in found]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g.size for g in found], pa.int64()), pa.array(hits, pa.list_(pa.float64()))], names=["row", "n", "hits"])

        return rows.select("row", "text").mapInArrow(run, "row long, n long, hits array<double>")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [decide(langs, hits, n) for n, hits in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], schema=PREDICTED)

    every = reduce(DataFrame.union, [pass_of(k) for k in range(parts)])
    total = F.aggregate(F.collect_list("hits"), F.array_repeat(F.lit(0.0), len(langs)), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    added = every.groupBy("row").agg(F.max("n").alias("n"), total.alias("hits"))
    return rows.select("doc_id", "row").join(added, "row").select("doc_id", "n", "hits").mapInArrow(settle, "doc_id long, lang_pred string, score double")
