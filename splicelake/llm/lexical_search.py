"""Ranked lexical search: the best documents of each item, by a threshold-seeded join.

1. One pass over the texts keeps, of each document, the terms that any item asks for. It is written once: a row a
   document, with term numbers and frequencies.
2. From these postings each term gets its document frequency, its greatest impact and its k-th greatest one. The k-th
   impact of any one of its terms is a lower bound of an item's k-th score.
3. An item's terms, weakest first, are pruned as long as their greatest impacts sum to less than that bound: a document
   that has no other of its terms can't be among the k best. The other terms generate candidates; a candidate whose sum
   plus the bound of the pruned terms stays below the threshold goes, and the rest are scored with all terms, exactly.
4. A task keeps k documents an item at most and raises its thresholds as it goes; a window over what the tasks keep ranks
   them. Postings are never shuffled, but for counts by term and frequency, which combine in the map tasks.

What is sent to all tasks are terms and weights of a block of items: blocks are made until none has over `BLOCK` bytes of
terms (or it is a single item, whose text a task holds anyway), and each block has its own pass.

Defined results: null and empty texts, of either table, have no term. Rows of one item_id (null too) make one item of all
their terms. Each row of documents is a document: repeated rows take a rank each; of equal scores a null doc_id comes
first. Items without a scored document, and empty tables, give no rows. doc_id keeps its type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shape

K = 50
BLOCK = 16 << 20
#: Bytes of text, and cells of documents by items, that a task takes at once.
SLICE = 4 << 20
CELLS = 1 << 21
#: What a byte becomes before texts are cut at blanks: A-Z are lowered, other ASCII than letters and digits is a blank.
BYTES = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have at most `most` bytes together, or are one."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    start, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size + n > most and i > start:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def terms_of(texts: pa.Array, to: np.ndarray = BYTES) -> tuple[np.ndarray, pa.Array]:
    """The row and the term of each match, in order: what is between blanks once each byte is what `to` makes of it."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    plain = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(to[raw].tobytes()))
    cut = pc.ascii_split_whitespace(plain)
    rows, flat = np.asarray(pc.list_parent_indices(cut)), pc.list_flatten(cut)
    full = np.asarray(pc.binary_length(flat)) > 0
    return rows[full], flat.filter(pa.array(full))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in slices(b.column(1)):
                part = b.slice(s, e - s)
                rows, terms = terms_of(part.column(1))
                once = pa.table({"row": rows, "term": terms}).group_by(["row", "term"]).aggregate([])
                yield from pa.table({"item_id": part.column(0).take(once["row"].combine_chunks()), "term": once["term"]}).to_batches()

    return items.select("item_id", "text").mapInArrow(run, shape("item_id long, term string", item_id=items)).distinct()


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """key, doc_id, n, terms (places in `terms`), tfs: a row for each document with a term, of any kind."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value, pa.string())
        key = TaskContext.get().partitionId() << 36
        for b in batches:
            for s, e in slices(b.column(1)):
                part = b.slice(s, e - s)
                rows, found = terms_of(part.column(1))
                n = np.bincount(rows, minlength=e - s)
                at = pc.index_in(found, value_set=wanted)
                known = np.asarray(at.is_valid())
                both = rows[known].astype(np.int64) * max(1, len(wanted)) + np.asarray(at.drop_null()).astype(np.int64)
                both, tf = np.unique(both, return_counts=True)
                row, term = np.divmod(both, max(1, len(wanted)))
                full = np.flatnonzero(n)
                offsets = pa.array(np.append(np.searchsorted(row, full), len(row)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key + np.arange(len(full), dtype=np.int64)), part.column(0).take(pa.array(full)), pa.array(n[full].astype(np.int64)),
                        pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
                    ],
                    names=["key", "doc_id", "n", "terms", "tfs"],
                )
                key += len(full)

    return docs.select("doc_id", "text").mapInArrow(run, shape("key long, doc_id long, n long, terms array<int>, tfs array<int>", doc_id=docs))


def length_factor(n, total_docs: int, total_terms: int):
    """A document's m: for a column or an array of term numbers."""
    return 50 + (50 * n * total_docs) // total_terms


def term_statistics(held: DataFrame, k: int, total_docs: int, total_terms: int) -> DataFrame:
    """term, w, most, kth: its weight, and its greatest and k-th greatest impact (0 if fewer documents have it)."""
    m = F.expr(f"50 + (50 * n * {total_docs}L) div {total_terms}L")
    each = held.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(F.col("t.terms").alias("term"), F.expr("(1000000000L * t.tfs) div (1000L * t.tfs + 20 * m)").alias("base"))
    counts = each.groupBy("term", "base").agg(F.count("*").alias("c"))
    above = F.sum("c").over(Window.partitionBy("term").orderBy(F.desc("base")))
    stats = counts.withColumn("above", above).groupBy("term").agg(
        F.sum("c").alias("df"), F.max("base").alias("top"), F.max(F.when(F.col("above") >= k, F.col("base"))).alias("kth")
    )
    w = F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * total_docs + 2.0) / (F.lit(2.0) * F.col("df") + 1.0)))
    return stats.withColumn("w", w).select("term", "w", (F.col("w") * F.col("top")).alias("most"), (F.col("w") * F.coalesce("kth", F.lit(0))).alias("kth"))


def pruned_terms(asked: DataFrame, stats: DataFrame) -> DataFrame:
    """item, term, w, threshold, pruned, rest: `asked` (item, term) with the item's threshold, whether the term may be
    left out when candidates are generated, and the bound of all that may."""
    item = Window.partitionBy("item")
    t = asked.join(stats, "term").withColumn("threshold", F.max("kth").over(item))
    t = t.withColumn("upto", F.sum("most").over(item.orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("pruned", F.col("upto") < F.col("threshold"))
    return t.withColumn("rest", F.sum(F.when(F.col("pruned"), F.col("most")).otherwise(0)).over(item)).select("item", "term", "w", "threshold", "pruned", "rest")


class Index:
    """Items by term, for one block of items: terms that generate candidates, and pruned ones."""

    def __init__(self, rows: list[tuple[int, int, int, int, bool, int]], n_items: int, n_terms: int) -> None:
        item, term, w, threshold, pruned, rest = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else np.zeros((6, 0), np.int64)
        self.items, self.threshold, self.rest = n_items, np.zeros(n_items, np.int64), np.zeros(n_items, np.int64)
        self.threshold[item], self.rest[item] = threshold, rest
        self.parts = []
        for which in (pruned == 0, pruned == 1):
            order = np.argsort(term[which], kind="stable")
            starts = np.searchsorted(term[which][order], np.arange(n_terms + 1))
            self.parts.append((starts, item[which][order], w[which][order]))

    def add(self, scores: np.ndarray, rows: np.ndarray, terms: np.ndarray, base: np.ndarray, pruned: bool) -> None:
        """Adds to `scores` (documents by items, flat) what these postings give to generating or pruned terms."""
        starts, item, w = self.parts[pruned]
        first, many = starts[terms], starts[terms + 1] - starts[terms]
        ends = np.cumsum(many)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + many, many)
        np.add.at(scores, np.repeat(rows, many) * self.items + item[at], np.repeat(base, many) * w[at])


def best(found: pa.Table, k: int) -> pa.Table:
    """Of each item the k best rows."""
    order = pc.sort_indices(found, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start")
    found = found.take(order)
    item = np.asarray(found["item"])
    return found.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < k))


def ranked(held: DataFrame, index: Index, k: int, total_docs: int, total_terms: int) -> DataFrame:
    """item, doc_id, key, score: of each task and item the k best at most."""
    sent = held.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        threshold, kept = index.threshold.copy(), None
        for b in batches:
            n, (lists, tfs) = np.asarray(b.column(2)), (b.column(3), b.column(4))
            m = length_factor(n.astype(np.int64), total_docs, total_terms)
            rows, terms, tf = np.asarray(pc.list_parent_indices(lists)).astype(np.int64), np.asarray(pc.list_flatten(lists)), np.asarray(pc.list_flatten(tfs)).astype(np.int64)
            base = (1_000_000_000 * tf) // (1000 * tf + 20 * m[rows])
            step = max(1, CELLS // max(1, index.items))
            for s in range(0, b.num_rows, step):
                size = min(step, b.num_rows - s)
                lo, hi = np.searchsorted(rows, (s, s + size))
                r, t, x = rows[lo:hi] - s, terms[lo:hi], base[lo:hi]
                scores = np.zeros(size * index.items, np.int64)
                index.add(scores, r, t, x, False)
                table = scores.reshape(size, index.items)
                candidate = (table > 0) & (table + index.rest >= threshold)
                some = candidate.any(axis=1)[r]
                index.add(scores, r[some], t[some], x[some], True)
                doc, item = np.nonzero(candidate & (table >= threshold))
                if not len(doc):
                    continue
                at = pa.array(doc + s)
                new = pa.table({"item": item, "doc_id": b.column(1).take(at), "key": b.column(0).take(at), "score": table[doc, item]})
                kept = best(new if kept is None else pa.concat_tables([kept, new]), k)
                item, score = np.asarray(kept["item"]), np.asarray(kept["score"])
                last = np.flatnonzero(np.arange(len(item)) - np.searchsorted(item, item) == k - 1)
                threshold[item[last]] = np.maximum(threshold[item[last]], score[last])
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    return held.mapInArrow(run, shape("item long, doc_id long, key long, score long", doc_id=held))


def blocks_of(asked: DataFrame, most: int) -> tuple[DataFrame, int]:
    """`asked` with the block of its item, and the number of blocks: none has over `most` bytes of terms, or it is one item."""
    n = 1
    while True:
        dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
        sizes = dealt.groupBy("block", "item_id").agg(F.sum(F.octet_length("term") + 8).alias("b")).groupBy("block").agg(F.sum("b").alias("b"), F.count("*").alias("items"))
        if n >= 1 << 20 or sizes.filter((F.col("b") > most) & (F.col("items") > 1)).isEmpty():
            return dealt, n
        n *= 2


def search(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of `docs` (doc_id, text) for each of `items` (item_id, text)."""
    asked, n_blocks = blocks_of(materialise(item_terms(items), "search-items"), block)
    out = None
    for b in range(n_blocks):
        rows = asked.filter(F.col("block") == b).select("item_id", "term").collect()  # `block` bytes at most, or one item
        if not rows and b < n_blocks - 1:
            continue
        terms = sorted({r["term"] for r in rows})
        ids = sorted({r["item_id"] for r in rows}, key=lambda x: (x is not None, x))
        place, number = {t: i for i, t in enumerate(terms)}, {x: i for i, x in enumerate(ids)}
        found = _search_block(docs, [(number[r["item_id"]], place[r["term"]]) for r in rows], terms, len(ids), k)
        spark = docs.sparkSession
        names = spark.createDataFrame(list(enumerate(ids)), shape("item long, item_id long", item_id=items))
        found = found.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(docs: DataFrame, asked: list[tuple[int, int]], terms: list[str], n_items: int, k: int) -> DataFrame:
    spark = docs.sparkSession
    held = materialise(postings(docs, terms), "search-postings")
    total_docs, total_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    stats = term_statistics(held, k, total_docs, max(1, total_terms))
    chosen = pruned_terms(spark.createDataFrame(asked, "item long, term int"), stats)
    index = Index([tuple(r) for r in chosen.collect()], n_items, len(terms))
    found = ranked(held, index, k, total_docs, max(1, total_terms))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), "key"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
