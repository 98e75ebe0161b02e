"""Quality classifier: histogram gradient-boosted trees over document statistics.

One pass over the whole texts makes `FEATURES` of each document (numpy and Arrow on slices of texts, in tasks), written
once. Trees are fitted on a bounded sample of the labelled training rows (`MAX_ROWS`, the first by a hash of their
statistics): values are cut into `BINS` by quantiles, a node's histograms of gradients give its best split, a child's
come from its parent's less its sibling's. The trees are complete, flattened into arrays of feature and threshold by
node, and a batch of documents walks down all of them level by level, as numpy indexing. The score is the logistic of
the leaves' sum.

Defined results: a null text is empty; it has statistics of 0. Without labelled rows every score is 0.5, with one class
alone it is the training rate, drawn towards 0.5 by one row. An id with several labels is of low quality if one is 0.
Repeated rows give a row each. doc_id keeps its type; a null one has a score and no label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, shape
from .lexical_search import slices

MAX_ROWS = 50_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
#: Weight of the pull of leaves to 0, and the least sum of second derivatives on either side of a split.
PULL = 2.0
LEAST = 2.0
CUTOFF = 0.3

#: Kinds of bytes; characters outside ASCII count once, by their first byte.
KINDS = ("lower", "upper", "digit", "blank", "stop", "comma", "bang", "mark", "bar", "other", "wide", "tail")
_OF = {**{c: "stop" for c in b".?"}, **{c: "comma" for c in b",;:'\"-()"}, ord("!"): "bang", **{c: "mark" for c in b"#*$%&<>@^~=+_\\{}[]"}, ord("|"): "bar"}
KIND = np.array(
    [
        KINDS.index(
            "lower" if 97 <= b <= 122 else "upper" if 65 <= b <= 90 else "digit" if 48 <= b <= 57 else "blank" if b == 32 or 9 <= b <= 13
            else "tail" if 128 <= b < 192 else "wide" if b >= 192 else _OF.get(b, "other")
        )
        for b in range(256)
    ],
    np.uint8,
)
FEATURES = (
    *[f"share_{k}" for k in KINDS[:-1]], "log_chars", "log_words", "word_mean", "word_spread", "word_longest", "words_short", "words_long", "words_upper", "words_marked",
    "words_distinct", "words_top", "pairs_distinct", "windows_repeated", "log_lines", "line_words", "lines_repeated", "lines_empty",
)


def _per(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, minlength=n)


def _distinct(rows: np.ndarray, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different codes a row has, and how often its most frequent one."""
    order = np.lexsort((codes, rows))
    r, c = rows[order], codes[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    starts = np.flatnonzero(new)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, r[starts], np.diff(np.append(starts, len(r))))
    return np.bincount(r[starts], minlength=n), most


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts without nulls, and where each starts (and the last ends)."""
    data, offsets = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of `FEATURES` a text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    n = len(texts)
    raw, at = _bytes(texts)
    kinds = np.bincount(np.repeat(np.arange(n) * len(KINDS), np.diff(at)) + KIND[raw], minlength=n * len(KINDS)).reshape(n, len(KINDS))[:, :-1]
    chars = kinds.sum(axis=1)
    over = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)

    cut = pc.ascii_split_whitespace(texts)
    row, words = np.asarray(pc.list_parent_indices(cut)).astype(np.int64), pc.list_flatten(cut)
    full = np.asarray(pc.binary_length(words)) > 0
    row, words = row[full], words.filter(pa.array(full))
    code = np.asarray(words.dictionary_encode().indices).astype(np.int64)
    length = np.asarray(pc.utf8_length(words)).astype(np.float64)
    inside, starts = _bytes(words)
    kind = KIND[inside]
    has = lambda *names: np.diff(np.append(0, np.cumsum(np.isin(kind, [KINDS.index(k) for k in names])))[starts])
    letters, upper, marked = has("lower", "upper", "wide"), has("upper"), has("mark", "bar", "bang")
    many = np.bincount(row, minlength=n)
    mean = over(_per(length, row, n), many)
    spread = np.sqrt(over(_per((length - mean[row]) ** 2, row, n), many))
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    distinct, top = _distinct(row, code, n)
    near = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    pair = (code[:-1] * (code.max(initial=0) + 1) + code[1:])[near]
    pairs, _ = _distinct(row[:-1][near], pair, n)
    n_pairs = np.bincount(row[:-1][near], minlength=n)
    # Windows of five words by a 64-bit hash of their codes.
    window = np.zeros(max(0, len(code) - 4), np.uint64)
    for k in range(5):
        window = (window ^ code[k : k + len(window)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        window ^= window >> np.uint64(29)
    whole = row[4:] == row[: len(window)]
    in_row = row[: len(window)][whole]
    windows, _ = _distinct(in_row, window[whole].view(np.int64), n)
    n_windows = np.bincount(in_row, minlength=n)

    lines = pc.split_pattern(texts, "\n")
    line_row, line = np.asarray(pc.list_parent_indices(lines)).astype(np.int64), pc.list_flatten(lines)
    n_lines = np.bincount(line_row, minlength=n)
    blank = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(line))) == 0
    line_code = np.asarray(line.dictionary_encode().indices).astype(np.int64)[~blank]
    different, _ = _distinct(line_row[~blank], line_code, n)
    filled = np.bincount(line_row[~blank], minlength=n)

    share = lambda flag: over(_per(flag.astype(np.float64), row, n), many)
    columns = [
        *[over(kinds[:, k], chars) for k in range(kinds.shape[1])], np.log1p(chars), np.log1p(many), mean, spread, longest, share(length <= 2), share(length >= 12),
        share((upper > 1) & (upper == letters)), share(marked > 0), over(distinct, many), over(top, many), over(pairs, n_pairs), 1 - over(windows, n_windows) - (n_windows == 0),
        np.log1p(np.where(chars > 0, n_lines, 0)), over(many, filled), 1 - over(different, filled) - (filled == 0), np.where(chars > 0, over(n_lines - filled, n_lines), 0),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, x (the statistics) for every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in slices(b.column(1)):
                x = statistics(b.column(1).slice(s, e - s))
                offsets = pa.array(np.arange(e - s + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, shape("doc_id long, x array<float>", doc_id=docs))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Trees:
    """Complete trees of one depth, as arrays: feature and threshold by inner node (breadth first), value by leaf.

    A row goes right where its value is over the threshold; a node that isn't split has an infinite one.
    """

    def __init__(self, base: float, depth: int) -> None:
        self.base, self.depth = base, depth
        self.feature, self.threshold, self.value = (np.zeros((0, n)) for n in (2**depth - 1, 2**depth - 1, 2**depth))

    def append(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray) -> None:
        self.feature = np.vstack([self.feature, feature]).astype(np.int64)
        self.threshold, self.value = np.vstack([self.threshold, threshold]), np.vstack([self.value, value])

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.raw(x)) if len(x) else np.zeros(0)


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """For each feature at most `bins` - 1 values, as quantiles of the rows: a row's bin is the number of edges under it."""
    return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(x.shape[1])]


def histograms(codes: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray, bins: int) -> np.ndarray:
    """Sums of g and h by node, feature and bin. `node` under 0: the row isn't counted."""
    live = np.flatnonzero(node >= 0)
    features = codes.shape[1]
    at = ((node[live, None] * features + np.arange(features)) * bins + codes[live]).ravel()
    return np.stack([np.bincount(at, np.repeat(v[live], features), minlength=nodes * features * bins).reshape(nodes, features, bins) for v in (g, h)])


def best_splits(sums: np.ndarray, pull: float, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain (0 or less: no split), feature and bin (the last that goes left) of each node."""
    left = np.cumsum(sums, axis=3)
    all_g, all_h = left[0, :, :1, -1:], left[1, :, :1, -1:]
    gain = left[0] ** 2 / (left[1] + pull) + (all_g - left[0]) ** 2 / (all_h - left[1] + pull) - all_g**2 / (all_h + pull)
    gain = np.where((left[1] >= least) & (all_h - left[1] >= least), gain, 0)[:, :, :-1]
    flat = gain.reshape(len(gain), -1)
    top = flat.argmax(axis=1)
    feature, cut = np.divmod(top, gain.shape[2])
    return flat[np.arange(len(flat)), top], feature, cut


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, pull: float = PULL, least: float = LEAST) -> Trees:
    """Logistic loss, all trees of `depth`. `x`: rows by features, `y`: 0 or 1."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if not len(y) or y.min() == y.max():
        return model
    edges = bin_edges(x, bins)
    codes = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1).astype(np.int64)
    raw = np.full(len(y), model.base)
    for _ in range(trees):
        p = logistic(raw)
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        place, sums = np.zeros(len(y), np.int64), None
        for level in range(depth):
            if sums is None:
                sums = histograms(codes, place, 1, g, h, bins)
            else:  # the left children, and the right ones as what is left of their parents
                left = histograms(codes, np.where(place % 2 == 0, place // 2, -1), 2 ** (level - 1), g, h, bins)
                sums = np.stack([left, sums - left], axis=2).reshape(2, 2**level, *sums.shape[2:])
            gain, best, cut = best_splits(sums, pull, least)
            for k in np.flatnonzero(gain > 1e-9):
                if cut[k] < len(edges[best[k]]):
                    feature[2**level - 1 + k], threshold[2**level - 1 + k] = best[k], edges[best[k]][cut[k]]
            node = 2**level - 1 + place
            place = 2 * place + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf_g, leaf_h = (np.bincount(place, v, minlength=2**depth) for v in (g, h))
        value = rate * leaf_g / (leaf_h + pull)
        model.append(feature, threshold, value)
        raw += value[place]
    return model


def learn(known: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> Trees:
    """Trees from at most `max_rows` of the labelled rows of `known` (as of `described`). `labels`: doc_id, quality."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = known.join(one, "doc_id").select(F.xxhash64("x").alias("key"), "doc_id", "x", "quality")
    n = rows.count()
    if n > max_rows:  # 5 % more than asked for, so that only few rows are sorted
        rows = rows.filter(F.pmod("key", F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.05 * max_rows / n)))
    sample = rows.orderBy("key", "doc_id").limit(max_rows).select("x", "quality").toArrow()
    x = np.asarray(pc.list_flatten(sample["x"].combine_chunks())).reshape(-1, len(FEATURES)) if len(sample) else np.zeros((0, len(FEATURES)), np.float32)
    return fit(x, np.asarray(sample["quality"]).astype(np.float64), **options)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, score, predicted for every row of `docs` (doc_id, text)."""
    known = materialise(described(docs), "quality-statistics")
    sent = docs.sparkSession.sparkContext.broadcast(learn(known, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(pc.list_flatten(b.column(1))).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value.score(x))], names=["doc_id", "score"])

    return known.mapInArrow(run, shape("doc_id long, score double", doc_id=docs)).withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
