"""N-gram scoring with a log-frequency Bloom filter.

Counts of words and word pairs are quantised to q = 1 + floor(log_1.5 count); an n-gram enters the filter
once for each level up to q, so repeated membership probes (level 1, 2, ... until one misses) give its
count back within a factor.

The filter is made in blocks and never as a whole: an n-gram's hash names its block, and all its counts and
all probes for it, one for each chunk of texts that has it, meet in one task, which writes the block's bits
and answers the probes. The answers go back to their chunk by its number. The number of blocks follows the
number of tokens and a block's size its n-grams, so no n-gram is cut and a task's share doesn't grow.

Model: P(w | u) = a c(u,w) / c(u) + (1 - a) (c(w) + d) / (N + d (V + 1)). The base score uses exact counts:
those of the most frequent words are broadcast (at most `HEAD` of them), those of the rest are joined.

Defined results: null and empty texts have the end token alone. With nothing to learn from, N = V = 0 and
every token has the same base probability. Repeated rows give a row each and count each in training.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

END = b"\n"  # no word holds white space
HEAD = 1 << 18
SEGMENT_TOKENS = 1 << 20
BITS_PER_ENTRY = 4
BASE, DELTA, WEIGHT = 1.5, 0.1, 0.3
MAX_LEVEL = 64
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M[2]
    h = (h ^ (h >> np.uint64(29))) * _M[1]
    return h ^ (h >> np.uint64(32))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words (A-Z only; parted by ASCII white space) and one end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


class _Codes(dict):
    """Numbers words in the order they come up."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all the texts on end, each token's number; the hashes of the different words, by number; the tokens of each text."""
    known = _Codes()
    per = [np.fromiter(map(known.__getitem__, tokens(t)), np.int64) for t in texts]  # only one text's words are held at a time
    n = np.fromiter(map(len, per), np.int64, len(per))
    codes = np.concatenate([np.empty(0, np.int64), *per])
    return codes, np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known)), n


def _lefts(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The number of each token's left word; a text's first follows an end, as its last token is one."""
    left = np.empty_like(codes)
    left[1:] = codes[:-1]
    left[np.cumsum(n) - n] = codes[-1:] if len(codes) else 0
    return left


def pair_key(left: np.ndarray, h: np.ndarray) -> np.ndarray:
    return _mix(left * _M[0] + h * _M[1] + np.uint64(2))


def word_key(h: np.ndarray) -> np.ndarray:
    return _mix(h + np.uint64(1))


def _chunks(column: pa.Array, chars: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Slices of a column of about so many bytes of text."""
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)) if len(column) and column.type == pa.string() else np.zeros(len(column))
    start, total = 0, 0
    for k, x in enumerate(size):
        total += int(x)
        if total >= chars:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(column):
        yield start, len(column)


def word_counts(train: DataFrame) -> DataFrame:
    """h, c: exact counts of the training tokens, by their 64-bit hash; added up batch by batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, h, _ = _coded(b.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(codes, minlength=len(h)))], names=["h", "c"])

    return train.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


# ---- the filter


def level(c: np.ndarray) -> np.ndarray:
    return np.minimum(MAX_LEVEL, 1 + np.floor(np.log(np.maximum(c, 1)) / math.log(BASE) + 1e-9)).astype(np.int64)


def value(q: np.ndarray) -> np.ndarray:
    """A level's count: the middle of its range; exactly 1, 2 and 3 for the first three."""
    q = q.astype(np.float64)
    return np.where(q <= 3, q, BASE ** (q - 1) * (1 + BASE) / 2)


def _probes(low: np.ndarray, q: int, bits: int) -> list[np.ndarray]:
    """Bit positions in its block of level q of n-grams: four at level 1, which turns unseen ones away, then two."""
    x = _mix(low * _M[0] + np.uint64(q))
    a, b = x & np.uint64(0xFFFFFFFF), (x >> np.uint64(32)) | np.uint64(1)
    return [((a + np.uint64(k) * b) % np.uint64(bits)).astype(np.int64) for k in range(4 if q == 1 else 2)]


def build_block(low: np.ndarray, c: np.ndarray, size: int = 64) -> np.ndarray:
    """A block with all the n-grams, of `size` bytes or as many more as leave three quarters of its bits or so unset."""
    q = level(c)
    bits = 8 * max(size, -(-BITS_PER_ENTRY * int((4 + 2 * (q - 1)).sum()) // 8))
    block = np.zeros(bits // 8, np.uint8)
    for k in range(1, int(q.max()) + 1 if len(q) else 0):
        low, q = low[q >= k], q[q >= k]
        for at in _probes(low, k, bits):
            np.bitwise_or.at(block, at >> 3, (1 << (at & 7)).astype(np.uint8))
    return block


class LogFrequencyFilter:
    def __init__(self, blocks: np.ndarray) -> None:
        self.blocks = blocks  # segments x bytes

    def levels(self, key: np.ndarray) -> np.ndarray:
        """Highest levels up to which all are found; 0 where level 1 misses."""
        segments, size = self.blocks.shape
        flat = self.blocks.reshape(-1)
        origin = _segment(key, segments) * size
        low, q, live = key & np.uint64((1 << 40) - 1), np.zeros(len(key), np.uint8), np.arange(len(key))
        for k in range(1, MAX_LEVEL + 1):
            hit = np.ones(len(live), bool)
            for at in _probes(low[live], k, size * 8):
                hit &= (flat[origin[live] + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1
            live = live[hit]
            if not len(live):
                break
            q[live] = k
        return q

    def counts(self, key: np.ndarray) -> np.ndarray:
        """Estimated counts; 0 where level 1 misses."""
        q = self.levels(key)
        return np.where(q > 0, value(q), 0.0)


def segments_for(n_tokens: int) -> int:
    """Blocks: a power of two, for `SEGMENT_TOKENS` tokens each, however many."""
    return max(64, 1 << max(0, math.ceil(math.log2(max(1, n_tokens) / SEGMENT_TOKENS))))


def _segment(key: np.ndarray, segments: int) -> np.ndarray:
    return ((_mix(key + np.uint64(3)) >> np.uint64(1)) % np.uint64(segments)).astype(np.int64)


def _by_segment(key: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys' order by segment and their 40 bits, and their segments in that order."""
    seg, low = _segment(key, segments), key & _LOW
    order = np.argsort(seg.astype(np.uint64) << np.uint64(40) | low) if segments <= 1 << 24 else np.lexsort((low, seg))
    return order, seg[order]


_LOW = np.uint64((1 << 40) - 1)
_MOST = 255


def _shut(low: np.ndarray, c: np.ndarray | None = None) -> bytes:
    """Rising numbers of 40 bits, by their differences, and counts of a byte each: byte by byte of all, compressed."""
    planes = np.diff(low, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :5].T
    return zstandard.compress(np.vstack([planes, *([] if c is None else [c.astype(np.uint8)])]).tobytes(), 1)


def _opened(data: bytes, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and the last of `rows` bytes of each."""
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(rows, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :5] = planes[:5].T
    return np.cumsum(steps.view(np.uint64).reshape(-1), dtype=np.uint64), planes[-1]


def _pressed(x: np.ndarray) -> tuple[str, bytes]:
    """An array's bytes, the lowest of all numbers first, then the next: most higher ones are 0."""
    return x.dtype.str, zstandard.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), 1)


def _released(kind: str, data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


PARTS = "segment long, chunk long, data binary"


def _parts(low: np.ndarray, c: np.ndarray | None, ids: np.ndarray, chunk: int) -> pa.RecordBatch:
    """A row for each segment in `ids`, which are in order."""
    edge = np.flatnonzero(np.diff(ids, prepend=-1))
    ends = np.append(edge[1:], len(ids))
    data = [_shut(low[x:y], None if c is None else c[x:y]) for x, y in zip(edge, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids[edge]), pa.array(np.full(len(edge), chunk)), pa.array(data, pa.binary())], names=["segment", "chunk", "data"])


def counted(train: DataFrame, segments: int) -> DataFrame:
    """The n-grams' counts by segment, under chunk -1: some 4 bytes an n-gram of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, e in _chunks(b.column(0), 1 << 24):
                codes, h, n = _coded(b.column(0).slice(s, e - s).to_pylist())
                pairs, c_pairs = np.unique(_lefts(codes, n) * len(h) + codes, return_counts=True)
                key = np.concatenate((word_key(h), pair_key(h[pairs // len(h)], h[pairs % len(h)])))
                c = np.concatenate((np.bincount(codes, minlength=len(h)), c_pairs))
                order, ids = _by_segment(key, segments)
                low, c = key[order] & _LOW, c[order]
                extra = (c - 1) // _MOST  # a count too large for its field goes on in further entries
                if extra.any():
                    again = np.repeat(np.arange(len(low)), extra + 1)
                    c = np.minimum(_MOST, c[again] - _MOST * (np.arange(len(again)) - np.searchsorted(again, again)))
                    low, ids = low[again], ids[again]
                yield _parts(low, c, ids, -1)

    return train.select("text").mapInArrow(run, PARTS)


def _grams(codes: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different words' and then pairs' keys; each token's left word and pair by number."""
    import pandas as pd

    left = _lefts(codes, n)
    back, pairs = pd.factorize(left * len(h) + codes)
    return np.concatenate((word_key(h), pair_key(h[pairs // len(h)], h[pairs % len(h)]))), left, back


def asked(docs: DataFrame, segments: int) -> DataFrame:
    """The probes of each chunk of texts by segment, once for each different n-gram: some 3.6 bytes each; and what the chunk itself
    needs to be scored, under a negative segment. `docs`: doc_id, row, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for b in batches:
            for s, e in _chunks(b.column(2), 1 << 23):
                part = b.slice(s, e - s)
                codes, h, n = _coded(part.column(2).to_pylist())
                key = _grams(codes, h, n)[0]
                order, ids = _by_segment(key, segments)
                yield _parts(key[order] & _LOW, None, ids, chunk)
                own = part.column(0).to_pylist(), part.column(1).to_pylist(), _pressed(codes.astype(np.min_scalar_type(len(h)))), h, n
                yield pa.RecordBatch.from_arrays([pa.array([-1 - chunk]), pa.array([chunk]), pa.array([pickle.dumps(own)], pa.binary())], names=["segment", "chunk", "data"])
                chunk += 1

    return docs.mapInArrow(run, PARTS)


def answered(parts: DataFrame) -> DataFrame:
    """Of each segment's probes the levels, a byte each in the probes' order; chunks go through as they are."""

    def block(t: pa.Table) -> pa.Table:
        if t.column("segment")[0].as_py() < 0:
            return t
        chunk = t.column("chunk").to_numpy()
        data = t.column("data").to_pylist()
        got = [_opened(x, 6) for x, k in zip(data, chunk, strict=True) if k < 0]
        key, back = np.unique(np.concatenate([np.empty(0, np.uint64), *[x[0] for x in got]]), return_inverse=True)
        c = np.bincount(back, weights=np.concatenate([np.empty(0, np.uint8), *[x[1] for x in got]]), minlength=len(key))
        model = LogFrequencyFilter(build_block(key, c)[None])
        keep = chunk >= 0
        levels = [zstandard.compress(model.levels(_opened(x, 5)[0]).tobytes(), 1) for x, k in zip(data, keep, strict=True) if k]
        return pa.table({"segment": pa.array(t.column("segment").to_numpy()[keep]), "chunk": pa.array(chunk[keep]), "data": pa.array(levels, pa.binary())})

    return parts.groupBy("segment").applyInArrow(block, PARTS)


# ---- scoring


def score(docs: DataFrame, train: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of `docs`, learning from `train`."""
    spark = docs.sparkSession
    exact = materialise(word_counts(train), "lm-words")
    total, distinct = (int(x or 0) for x in exact.agg(F.sum("c"), F.count("*")).first())
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = segments_for(max(total, chars // 6))
    norm = math.log10(total + DELTA * (distinct + 1))
    # The least count of which there are at most `head` words or fewer; sizes by power of two come to the driver.
    size, least = 0, 63
    for power, n in sorted(exact.groupBy(F.floor(F.log2("c")).cast("int").alias("p")).count().collect(), reverse=True):
        if size + n > head:
            break
        size, least = size + n, power
    frequent = exact.filter(F.col("c") >= F.lit(2**least if least < 63 else 2**62)).toArrow()
    fh, fc = frequent.column("h").to_numpy().view(np.uint64), frequent.column("c").to_numpy()
    order = np.argsort(fh)
    sent = spark.sparkContext.broadcast((fh[order], fc[order].astype(np.float64)))

    def finish(t: pa.Table) -> pa.Table:
        """Of a chunk a row for each text with its scores as far as the broadcast data give them, and the rarer words' hashes."""
        fh, fc = sent.value
        segment = t.column("segment").to_numpy()
        data = t.column("data").to_pylist()
        ids, row, codes, h, n = pickle.loads(data[int(np.argmin(segment))])
        codes = _released(*codes).astype(np.int64)
        key, left, back = _grams(codes, h, n)
        q = np.empty(len(key), np.uint8)
        q[_by_segment(key, segments)[0]] = np.frombuffer(b"".join([zstandard.decompress(data[k]) for k in np.argsort(segment)[1:]]), np.uint8)
        c_grams = np.where(q > 0, value(q), 0.0)
        doc = np.repeat(np.arange(len(n)), n)
        at = np.minimum(np.searchsorted(fh, h), max(0, len(fh) - 1))
        common = fh[at] == h if len(fh) else np.zeros(len(h), bool)
        c_common = np.where(common, fc[at], 0.0) if len(fh) else np.zeros(len(h))
        is_common = common[codes]
        base = np.bincount(doc[is_common], (np.log10(c_common + DELTA) - norm)[codes[is_common]], len(n)).astype(np.float64)
        known = np.bincount(doc[is_common], minlength=len(n))
        c_word, c_left = c_grams[codes], c_grams[left]
        c_pair = np.minimum(c_grams[len(h) :][back], c_word)
        p = np.where(c_left > 0, 1 - WEIGHT, 1.0) * (c_word + DELTA) / 10**norm
        seen = (c_pair > 0) & (c_left > 0)
        p[seen] += WEIGHT * np.minimum(1.0, c_pair[seen] / np.maximum(c_left[seen], 1))
        total_score = np.bincount(doc, np.log10(np.minimum(p, 1.0)), len(n))
        rare_h, rare_doc = h[codes[~is_common]], doc[~is_common]
        by = np.lexsort((rare_h, rare_doc))
        rare_h, rare_doc = rare_h[by], rare_doc[by]
        ends = np.cumsum(np.bincount(rare_doc, minlength=len(n)))
        rare = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(rare_h.view(np.int64)))
        columns = [pa.array(ids, pa.int64()), pa.array(row, pa.int64()), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), pa.array(total_score), rare]
        return pa.table(columns, names=["doc_id", "row", "n_tokens", "known", "base", "score", "rare"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    parts = answered(counted(train, segments).unionAll(asked(texts, segments)))
    rows = parts.groupBy("chunk").applyInArrow(finish, "doc_id long, row long, n_tokens long, known long, base double, score double, rare array<long>")
    rows = materialise(rows, "lm-rows")
    rare = rows.select("row", F.explode("rare").alias("h")).join(exact.filter(F.col("c") < F.lit(2**least if least < 63 else 2**62)), "h", "left")
    more = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(DELTA)) - F.lit(norm)).alias("base_rare"), F.count("c").alias("known_rare")
    )
    return rows.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), "score",
    )
