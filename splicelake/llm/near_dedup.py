"""MinHash near-duplicates with odd sketches.

A document's shingle set is reduced to `BANDS * ROWS` MinHash samples. Bands of samples give buckets; the
samples, each with its index, are folded into a parity bitmap (odd sketch) whose XOR population count tells
in how many samples two documents differ. Candidates that the sketch rules out (at odds far below one in a
billion for a pair at the threshold) are dropped at once; the others are confirmed on their full sets.

A bucket never gives all its pairs. First each member is paired with the bucket's most central one, which
shares the largest buckets (a star); confirmed links give components. Then only members that the star left
in another component than the bucket's pivot are looked at again: in buckets of up to `SMALL` members
beside all members of other components; in larger ones by an exact prefix filter, that is on sharing one of
a document's rarest shingles, of which a pair at the threshold must share one. A member that is too far
from its pivot has rare shingles enough, so this doesn't pair it with the group. No link that could join
two components is lost. Equal sets are one document until the end, so copies cost but the final join.

A pair at similarity 0.8 shares no band with probability (1 - 0.8**4)**30 < 2e-7.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing; a text of
fewer words than a shingle is one shingle. Rows repeated under one id count as that id's document once for
each different set. Rows without an id are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_id, discard, materialise

ROWS, BANDS = 4, 30
SKETCH_WORDS = 16  # of 64 bits
#: Members of buckets in which those that the star left are compared with all others.
SMALL = 16
_K = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's shingles."""

    def __init__(self, width: int) -> None:
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        known, h = self.known, xxhash.xxh64_intdigest
        if len(known) > 100_000:
            known.clear()
        out = np.empty(len(words), np.uint64)
        for k, w in enumerate(words):
            x = known.get(w)
            if x is None:
                x = known[w] = h(w)
            out[k] = x
        n = min(self.width, len(words))
        if not n:
            return out
        total = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            total = _mix(total * _K + out[k : len(words) - n + 1 + k])
        return np.unique(total)


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), np.iinfo(np.uint64).max)
    for at in range(0, len(s), 2048):
        out = np.minimum(out, (s[None, at : at + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity of the (index, sample) pairs that fall on each bit."""
    bits = SKETCH_WORDS * 64
    at = (_mix(samples + np.arange(len(samples), dtype=np.uint64) * _K) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def most_differing(threshold: float, sigmas: float = 6.0) -> int:
    """XOR bits beyond which a pair at `threshold` is out of the question: two for each sample that differs, at most."""
    n = ROWS * BANDS
    return int(2 * (n * (1 - threshold) + sigmas * (n * threshold * (1 - threshold)) ** 0.5) + 1)


SIGNED = "doc_id long, n_shingles long, set_key string, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(width)
        for b in batches:
            n, keys, bands, sketches = [], [], [], []
            for x in b.column(1):
                s = of(x.as_py())
                n.append(len(s))
                if not len(s):
                    keys.append(None)
                    bands.append([])
                    sketches.append([])
                    continue
                keys.append(xxhash.xxh128_hexdigest(s.tobytes()))
                m = minhash(s)
                rows = m.reshape(BANDS, ROWS)
                band = np.arange(BANDS, dtype=np.uint64)
                for k in range(ROWS):
                    band = _mix(band * _K + rows[:, k])
                bands.append(band.view(np.int64))
                sketches.append(odd_sketch(m).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "bands", "sketch"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNED)


def _confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b, of the pairs whose full sets are similar enough, written; `pairs` goes. Each set travels to its pairs' tasks; none is collected."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(x.as_py()).tobytes() for x in b.column(1)], pa.binary())], names=["doc_id", "set"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                ok.append(100 * inter >= percent * (len(both) - inter))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    need = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(need, "doc_id", "left_semi").mapInArrow(sets, "doc_id long, set binary"), "dedup-sets")
    with_b = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
    both = with_b.join(own.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a").select("a", "b", "set_a", "set_b")
    links = materialise(both.mapInArrow(check, "a long, b long").distinct(), "dedup-links")
    discard(own, pairs)
    return links


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """id, component (its smallest reachable id) for every id in `links` (a, b).

    Each round gives an id the smallest label about it, then its label's label; rounds follow the logarithm
    of a component's diameter or so. Labels never come to the driver; each round's are a written table.
    """
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    label = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"), name)
    label_written = label
    while True:
        near = both.join(label, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        better = label.join(near, F.col("id") == F.col("a"), "left").select("id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = label.select(F.col("id").alias("j"), F.col("label").alias("far"))
        after = materialise(better.join(jump, F.col("new") == F.col("j"), "left").select("id", "label", F.least("new", F.coalesce("far", "new")).alias("new")), name)
        if after.filter("new < label").isEmpty():
            discard(both)
            out = after.select("id", F.col("new").alias("component"))
            out._written = after._written
            return out
        discard(label_written)
        label_written, label = after, after.select("id", F.col("new").alias("label"))


def _candidates(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of pairs a < b, those whose sizes and sketches allow the similarity."""
    x = sketches.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("s_a"))
    y = sketches.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("s_b"))
    apart = reduce(lambda p, q: p + q, [F.bit_count(F.get("s_a", F.lit(k)).bitwiseXOR(F.get("s_b", F.lit(k)))) for k in range(SKETCH_WORDS)])
    sized = pairs.join(x, "a").join(y, "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.filter(apart <= most_differing(percent / 100)).select("a", "b")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: links hold where 100 * |A & B| >= percent * |A | B|."""
    return _near_duplicates(docs, width, percent)[0]


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The result and the written tables that it still reads."""
    signed = materialise(signatures(docs, width), "dedup-signatures")
    same = materialise(signed.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "dedup-same")
    reps = signed.join(same.select(F.col("rep").alias("doc_id"), "set_key"), ["doc_id", "set_key"], "left_semi")
    sketches = materialise(reps.select("doc_id", "set_key", "n_shingles", "bands", "sketch").dropDuplicates(["doc_id", "set_key"]), "dedup-reps")
    # One id may stand for several sets if its rows repeat with other texts: its sets are then one node.
    buckets = sketches.select(F.explode("bands").alias("bucket"), "doc_id").distinct()
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    shared = materialise(buckets.join(sizes, "bucket"), "dedup-shared")
    central = shared.groupBy("doc_id").agg(F.sum("members").alias("central"))
    ranked = shared.join(central, "doc_id")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("minus"))).alias("top")).select("bucket", (-F.col("top.minus")).alias("pivot"))
    members = materialise(shared.join(pivots, "bucket"), "dedup-buckets")
    star = members.filter("doc_id != pivot").select(F.least("pivot", "doc_id").alias("a"), F.greatest("pivot", "doc_id").alias("b")).distinct()
    source = by_id(docs.select("doc_id", "text"), shared, "left_semi")
    links = _confirm(source, materialise(_candidates(star, sketches, percent), "dedup-star"), width, percent)
    found = components(links)
    of = found.select(F.col("id").alias("doc_id"), "component")
    now = members.join(of, "doc_id", "left").select("bucket", "doc_id", "pivot", "members", F.coalesce("component", "doc_id").alias("component"))
    now = now.join(of.select(F.col("doc_id").alias("pivot"), F.col("component").alias("pivot_component")), "pivot", "left")
    now = materialise(now.withColumn("left", F.col("component") != F.coalesce("pivot_component", "pivot")).drop("pivot", "pivot_component"), "dedup-now")
    x = now.filter(F.col("left") & (F.col("members") <= SMALL)).select("bucket", F.col("doc_id").alias("x"), F.col("component").alias("cx"))
    y = now.filter(F.col("members") <= SMALL).select("bucket", F.col("doc_id").alias("y"), F.col("component").alias("cy"))
    pairs = x.join(y, "bucket").filter("cx != cy").select("x", "y").union(_by_rare_shingles(source, now, width, percent))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = _confirm(source, materialise(_candidates(pairs, sketches, percent), "dedup-rest"), width, percent)
    if not more.isEmpty():
        before, found = found, components(links.union(more))
        discard(before)
    discard(sketches, shared, members, now, links, more)
    return _finish(signed, same, found), [signed, same, found]


def _by_rare_shingles(source: DataFrame, now: DataFrame, width: int, percent: int) -> DataFrame:
    """x, y of different components, x left by the star in a large bucket: pairs that share one of both's rarest shingles.

    Of two sets at the threshold, each shares all but the rest of its (100 - percent) % rarest with the other, so in an
    order common to all (by frequency among these documents, then hash) their beginnings of that length and one meet.
    Where they first meet, all that both share is still to come, so what either has left there bounds it: a place too
    late in either for the similarity isn't taken.
    """
    large = now.filter(F.col("members") > SMALL)
    concerned = large.join(large.filter("left").select("bucket").distinct(), "bucket", "left_semi")
    ids = materialise(concerned.groupBy("doc_id").agg(F.max("left").alias("left"), F.min("component").alias("component")), "dedup-large")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(width)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(x.as_py()).view(np.int64) for x in b.column(1)], pa.list_(pa.int64()))], names=["doc_id", "s"])

    own = by_id(source, ids, "left_semi").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shingles, "doc_id long, s array<long>")
    each = materialise(own.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("s")), "dedup-shingles")
    often = each.groupBy("s").agg(F.count("*").alias("f"))
    ordered = each.join(often, "s").groupBy("doc_id", "n").agg(F.sort_array(F.collect_set(F.struct("f", "s"))).alias("all"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = ordered.select("doc_id", "n", F.posexplode(F.slice("all", F.lit(1), F.least(F.col("n"), first).cast("int"))).alias("at", "p"))
    prefix = materialise(prefix.select("doc_id", F.col("p.s").alias("s"), "n", (F.col("n") - F.col("at")).alias("rest")).join(ids, "doc_id"), "dedup-prefixes")
    discard(each)
    x = prefix.filter("left").select("s", F.col("doc_id").alias("x"), F.col("component").alias("cx"), F.col("n").alias("n_x"), F.col("rest").alias("rest_x"))
    y = prefix.select("s", F.col("doc_id").alias("y"), F.col("component").alias("cy"), F.col("n").alias("n_y"), F.col("rest").alias("rest_y"))
    enough = (100 + percent) * F.least("rest_x", "rest_y") >= percent * (F.col("n_x") + F.col("n_y"))
    return x.join(y, "s").filter((F.col("cx") != F.col("cy")) & enough).select("x", "y").distinct()


def _finish(signed: DataFrame, same: DataFrame, found: DataFrame) -> DataFrame:
    """Every document with the component of its set's smallest id."""
    rep = same.filter("n > 1").select("set_key", "rep")
    # Only rows whose set occurs again take part in the join; a set with very many copies is split by Spark's skew join.
    joined = signed.select("doc_id", "n_shingles", "set_key").join(rep, "set_key", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = joined.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def remove_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: the one with the smallest id. Rows without an id go."""
    result, written = _near_duplicates(docs, width, percent)
    good = materialise(result.filter("kept").select("doc_id"), "dedup-kept")
    discard(*written)
    return by_id(docs, good, "left_semi")
