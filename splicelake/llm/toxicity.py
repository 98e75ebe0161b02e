"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and word beginnings (inflected insults share them), and these once more if a text has them twice or
three times. Those whose presence goes with the label, in
either direction (odds `ODDS` times higher or lower) and beyond what chance gives among so many (false discovery
rate `CHANCE`), span the vectors: a
whole text's TF-IDF vector is projected on them, as the hundreds of other words in a text would only add noise to
its cosines. All documents' vectors are made in one pass; document frequencies come from all of them. The index
holds the labelled training examples (a bounded sample: at most `MAX_EXAMPLES`, the first by a hash of their text),
equal vectors merged. Examples are laid out in blocks; for a query each block's maximal weights give an upper bound
of its cosines, blocks are read best bound first, and reading stops when no block left can reach the k-th best: so
the neighbours are exact.

The score is the neighbours' similarity-weighted share of toxic examples, drawn towards the training rate; a
text without any of the terms gets the rate of the examples without any. Evidence: ids of nearest examples.

Defined results: null and empty texts have no term. Without labelled training rows, or with one class
alone, every score is the training rate (0 if there is none). Ties in similarity go by the examples' order.
Repeated rows give a row each; an id with several labels counts as toxic if any label is 1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id, materialise

MAX_EXAMPLES = 20_000
CHANCE = 0.5
ODDS = 4.0
K = 15
BLOCK = 64
PRIOR = 4.0
CUTOFF = 0.3
BEGINNINGS = (3, 4, 5, 6)
#: A term that occurs so often in a text, or more often, is a further term of it: a stray word comes once.
AGAIN = (2, 3)
WORD = re.compile(r"[^\W\d_]+")


def terms(words: set[str]) -> set[str]:
    """The words, and their beginnings marked with a hyphen."""
    out = set(words)
    for n in BEGINNINGS:
        out.update([w[:n] + "-" for w in words if len(w) > n])
    return out


def counted_terms(text: str | None) -> dict[str, int]:
    """All terms of a text with their frequency."""
    n: Counter = Counter()
    for w, c in Counter(WORD.findall((text or "").lower())).items():
        for t in terms({w}):
            n[t] += c
    return n | {f"{k}{t}": 1 for t, c in n.items() for k in AGAIN if c >= k}


def choose_terms(sample: DataFrame, least: int = 3, chance: float = CHANCE) -> list[str]:
    """The terms in `least` texts or more that go with the label. `sample`: text, toxic; bounded, and so are its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = Counter()
            toxic = Counter()
            for text, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                found = counted_terms(text.as_py()).keys()
                n.update(found)
                if y:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([toxic[x] for x in n], pa.int64())], names=["term", "n", "pos"])

    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic"))  # a copied text is one witness
    y, all_ = (int(x or 0) for x in sample.agg(F.sum("toxic"), F.count("*")).first())
    if not 0 < y < all_:
        return []
    counted = sample.select("text", "toxic").mapInArrow(run, "term string, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    rate = y / all_
    part = lambda a, q: F.when(a > 0, a * F.log(a / F.col("n") / q)).otherwise(0.0)
    gain = part(F.col("pos"), rate) + part(F.col("n") - F.col("pos"), 1 - rate)
    counted = materialise(counted.filter(F.col("n") >= least).withColumn("gain", gain), "toxic-terms")
    # By chance a gain of g or more comes with a probability of exp(-g) or so: the least g at which at most the share
    # `chance` of the terms found would be chance's. A count for each tenth of a gain comes to the driver.
    tenths = sorted(((r["g"], r["count"]) for r in counted.groupBy(F.floor(F.col("gain") * 10).alias("g")).count().collect()), reverse=True)
    tried, found, bound = sum(n for _, n in tenths), 0, math.inf
    for g, n in tenths:
        found += n
        if tried * math.exp(-g / 10) <= chance * found:
            bound = g / 10
    if bound == math.inf:
        return []
    times = (F.col("pos") + 0.5) / (F.col("n") - F.col("pos") + 0.5) * ((1 - rate) / rate)
    best = counted.filter((F.col("gain") >= bound) & ((times >= ODDS) | (times <= 1 / ODDS)))
    return [r["term"] for r in best.orderBy("term").select("term").collect()]


class Vectoriser:
    """Term numbers and frequencies of a text."""

    def __init__(self, chosen: list[str]) -> None:
        plain = sorted({t.lstrip("0123456789") for t in chosen})
        self.base, at = {t: k for k, t in enumerate(plain)}, {t: k for k, t in enumerate(chosen)}
        #: Of each plain term its number, and those for texts that have it again; -1 where not chosen.
        self.numbers = [(at.get(t, -1), [(k, at[f"{k}{t}"]) for k in AGAIN if f"{k}{t}" in at]) for t in plain]
        self.cache: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> tuple[list[int], list[int]]:
        cache, base, n = self.cache, self.base, Counter()
        if len(cache) > 300_000:
            cache.clear()
        for w, c in Counter(WORD.findall((text or "").lower())).items():
            got = cache.get(w)
            if got is None:
                got = cache[w] = tuple(sorted(base[t] for t in terms({w}) if t in base))
            for t in got:
                n[t] += c
        found = {}
        for t, c in n.items():
            one, more = self.numbers[t]
            if one >= 0:
                found[one] = c
            found.update((number, 1) for k, number in more if c >= k)
        ids = sorted(found)
        return ids, [found[t] for t in ids]


VECTORS = "doc_id long, terms array<int>, tf array<int>"


def vectors(docs: DataFrame, chosen: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Vectoriser(sent.value)
        for b in batches:
            got = [of(x.as_py()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1] for x in got], pa.list_(pa.int32()))], names=["doc_id", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, VECTORS)


class BlockMaxIndex:
    """Examples by unit TF-IDF vector, and per term and block the largest weight."""

    def __init__(self, rows: list[tuple[int, list[int], list[int], int]], idf: np.ndarray) -> None:
        """rows: doc_id, terms, tf, toxic."""
        self.idf = idf
        merged: dict[tuple, list] = {}
        none = [0, 0]
        for doc, terms_, tf, y in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
            if not terms_:
                none = [none[0] + 1, none[1] + y]
                continue
            x = merged.setdefault((tuple(terms_), tuple(tf)), [0, 0, []])
            x[0], x[1], x[2] = x[0] + 1, x[1] + y, [*x[2], doc][:3]
        n, pos = sum(1 for _ in rows), sum(r[3] for r in rows)
        self.rate = pos / n if n else 0.0
        self.none = (none[1] + PRIOR * self.rate) / (none[0] + PRIOR) if n else 0.0
        self.n = np.array([x[0] for x in merged.values()], float)
        self.pos = np.array([x[1] for x in merged.values()], float)
        self.docs = [x[2] for x in merged.values()]
        postings: dict[int, list[tuple[int, float]]] = {}
        for e, (t, f) in enumerate(merged):
            t = np.array(t)
            w = self.weigh(t, np.array(f))
            for a, b in zip(t.tolist(), w.tolist(), strict=True):
                postings.setdefault(a, []).append((e, b))
        self.n_blocks = -(-len(merged) // BLOCK)
        self.postings: dict[int, tuple] = {}
        for t, p in postings.items():
            e, w = np.array([x[0] for x in p]), np.array([x[1] for x in p])
            first = np.flatnonzero(np.diff(e // BLOCK, prepend=-1))
            blocks = e[first] // BLOCK
            bounds = np.append(first, len(e))
            self.postings[t] = (blocks, np.maximum.reduceat(w, first), dict(zip(blocks.tolist(), zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), strict=True)), e % BLOCK, w)

    def weigh(self, t: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(tf)) * self.idf[t]
        return w / np.sqrt((w * w).sum())

    def nearest(self, t: np.ndarray, tf: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and numbers of the k nearest examples with any term in common, best first."""
        q = [(*self.postings[a], b) for a, b in zip(t.tolist(), self.weigh(t, tf).tolist(), strict=True) if a in self.postings]
        bound = np.zeros(self.n_blocks)
        for blocks, most, _, _, _, b in q:
            bound[blocks] += b * most
        order = np.argsort(-bound, kind="stable")
        sims, ids, worst = np.empty(0), np.empty(0, np.int64), 0.0
        for block in order.tolist():
            if bound[block] <= 0 or len(sims) == k and bound[block] < worst - 1e-12:
                break
            s = np.zeros(BLOCK)
            for _, _, where, e, w, b in q:
                if block in where:
                    x, y = where[block]
                    s[e[x:y]] += b * w[x:y]
            hit = np.flatnonzero(s > 0)
            sims, ids = np.concatenate((sims, s[hit])), np.concatenate((ids, hit + block * BLOCK))
            keep = np.lexsort((ids, -np.round(sims, 12)))[:k]
            sims, ids = sims[keep], ids[keep]
            worst = sims[-1] if len(sims) == k else 0.0
        return sims, ids

    def score(self, t: list[int], tf: list[int]) -> tuple[float, list[int]]:
        if not t:
            return self.none, []
        sims, ids = self.nearest(np.array(t), np.array(tf))
        if not len(ids):
            return self.rate, []
        share = (sims @ self.pos[ids] + PRIOR * self.rate) / (sims @ self.n[ids] + PRIOR)
        return float(min(1.0, max(0.0, share))), [d for i in ids[:3] for d in self.docs[i][:1]]


def learn(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> tuple[BlockMaxIndex, DataFrame]:
    """The index, and the vectors of all `docs`. `labels`: doc_id and toxic of the rows to learn from."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labelled = docs.select("doc_id", "text").join(known, "doc_id")
    n = labelled.count()
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    even = labelled.filter(F.pmod(key, F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.05 * max_examples / max(1, n))))
    sample = materialise(even.withColumn("key", key).orderBy("key", "doc_id").limit(max_examples).drop("key"), "toxic-sample")
    chosen = choose_terms(sample)
    every = materialise(vectors(docs, chosen), "toxic-vectors")
    total = every.count()
    df = np.zeros(len(chosen))
    for r in every.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a chosen term
        df[r["t"]] = r["count"]
    idf = np.log1p(total / np.maximum(df, 1))
    own = vectors(sample.select((2 * F.col("doc_id") + F.col("toxic")).alias("doc_id"), "text"), chosen)
    rows = [(r[0] >> 1, list(r[1]), list(r[2]), r[0] & 1) for r in own.collect()]  # max_examples at most
    return BlockMaxIndex(rows, idf), every


SCORED = "doc_id long, score double, evidence array<long>"


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, score, predicted, evidence for every row of `docs`."""
    index, every = learn(docs, labels, **options)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = sent.value, {}
        for b in batches:
            got = []
            for t, tf in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                key = (tuple(t), tuple(tf))
                if key not in known:
                    if len(known) > 100_000:
                        known.clear()
                    known[key] = index.score(t, tf)
                got.append(known[key])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.float64()), pa.array([x[1] for x in got], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    return every.mapInArrow(run, SCORED).withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents not predicted toxic, with all their columns. Of rows with one id, if one is toxic all go."""
    bad = score(docs, labels).filter("predicted = 1").select("doc_id")
    return by_id(docs, bad, "left_anti")
