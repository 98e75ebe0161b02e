"""Removal of repeated byte strings, by a Burrows-Wheeler transform and threshold-bounded interval expansion.

Bytes are to go that a string of `length` bytes covers which starts twice or more in the corpus. Three steps:

1. Anchors. In the first `SURE` bytes of every window of `length` bytes, one 64-byte string is chosen by content
   alone (the smallest hash), so equal windows have equal anchors. Anchors that occur once lead nowhere. The
   others give contexts: the bytes of up to `RUN` consecutive windows that have the anchor, so each window is in
   one context. A text of one repeated letter or phrase thus gives a context for each `RUN` windows, not for
   each. Near a text's end windows are cut off there, down to `SURE` bytes.
2. Equal contexts of an anchor are merged and counted: one seen twice is repeated throughout.
3. The different contexts of an anchor meet in one task (of a very frequent anchor: see below). Those that share
   neither the bytes before nor those behind the anchor with another are left out: what a shared string of `hint`
   bytes has beside the anchor is to one side by half at least. Of the rest the
   suffix array and from it the Burrows-Wheeler transform of all of them are made, with symbols of 8 bytes.
   Breadth-first, intervals of suffixes are extended backward symbol by symbol, so that level m holds just
   the repeated strings of 8 m bytes; intervals of one suffix are dropped, and expansion stops at `length`.

The transform derives common prefixes by increasing value, so it also shows texts that share less than
`length` but at least `hint` bytes where their contexts meet: these get `longest_repeat` = `hint`. Strings of
`SURE` bytes or more have the same anchor wherever they occur, so all are found; shorter ones only if the anchor
lies in them. Nothing is removed for it.

An anchor with more than `MAX_GROUP` different contexts never meets in one task: its strings of `length`
bytes are counted by their hash instead, with sums before the shuffle, which is exact as well.

Defined results: null is the empty text; nothing is removed from texts shorter than `length`. Repeated rows
are repeats of each other. Matches never cross documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

GRAM = 64
SYMBOL = 8
MAX_GROUP = 2000
HINT = 256
#: Shared strings from this many bytes on are always seen: the fewer, the more contexts.
SURE = 320
#: Windows of a context; contexts, and slices of a long text, may be cut anywhere between windows.
RUN = 1024
SLICE = 1 << 20
#: Bytes of contexts that one transform is made over; a group larger than this is alone in its.
BATCH_BYTES = 1 << 18
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K[2]
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, width: int = GRAM) -> np.ndarray:
    """Hashes of all strings of `width` (a power of two) bytes."""
    h = data.astype(np.uint64) + np.uint64(1)
    step = 1
    while step < width:
        h = _mix(h[:-step] * _K[0] + h[step:] * _K[1])
        step *= 2
    return h


def anchors(data: bytes, sure: int = SURE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The smallest hash of a gram in each window of `sure` bytes, for runs of up to `RUN` consecutive windows that
    have the same: equal windows are in runs of equal hash. With the run's first and last window, and where in the run
    the gram is; -1 if it is the smallest at several places of it, so that the run may repeat itself."""
    if len(data) < sure:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = gram_hashes(np.frombuffer(data, np.uint8))
    span = sure - GRAM + 1
    pos = np.arange(len(h), dtype=np.uint64)
    # The place goes with the hash's upper bits, so that one minimum finds both; equal grams: the leftmost.
    bits = np.uint64(32)  # as many for any text, so that equal windows choose alike
    low = (h >> bits) << bits | pos
    width, least = 1, low
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(h) - span + 1], least[span - width : span - width + len(h) - span + 1])
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    least = h[place]
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    size = np.diff(np.append(first, len(least)))
    if (size > RUN).any():
        again = -(-size // RUN)
        first = np.repeat(first, again) + RUN * (np.arange(again.sum()) - np.repeat(np.cumsum(again) - again, again))
    last = np.append(first[1:], len(least)) - 1
    return least[first], first, last, np.where(place[first] == place[last], place[first] - first, -1)


def all_anchors(data: bytes, sure: int = SURE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """`anchors` of a text of any size, slice by slice."""
    for at in range(0, max(1, len(data) - sure + 1), SLICE):
        anchor, first, last, inside = anchors(data[at : at + SLICE + sure - 1], sure)
        yield anchor, first + at, last + at, inside


def suffix_array(first: np.ndarray, width: int) -> np.ndarray:
    """Order of all suffixes, by prefix doubling from `first`: a key that orders and tells apart all strings of
    `width` symbols. Some string in each part of the text must be its only one, so that doubling ends."""
    n = len(first)
    order = np.argsort(first)
    while True:
        key = first[order]
        new = np.empty(n, bool)
        new[0] = False
        np.not_equal(key[1:], key[:-1], out=new[1:])
        sorted_rank = np.cumsum(new)
        if sorted_rank[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = sorted_rank
        first = rank * (n + 1)
        first[: n - width] += rank[width:] + 1
        # Suffixes already told apart stay; only stretches of equal ones are sorted, all at once.
        alone = np.append(new[1:], True) & np.concatenate(([True], new[1:]))
        tied = np.flatnonzero(~alone)
        part = order[tied]
        order[tied] = part[np.argsort(first[part])]
        width *= 2


def repeated_windows(contexts: list[bytes], length: int, hint: int = HINT) -> tuple[list[np.ndarray], np.ndarray]:
    """For each context, the starts of its strings of `length` bytes that start at another place of the contexts;
    and whether it has one of `hint` bytes that does."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    n = int((sizes + 1).sum())
    text = np.empty(n, np.int64)
    for s, c in zip(starts, contexts, strict=True):
        text[s : s + len(c)] = np.frombuffer(c, np.uint8)
    ends = starts + sizes
    text[ends] = 256 + np.arange(len(contexts))  # each end differs from all else
    # The transform with symbols of 8 bytes: what stands before each suffix, and where that longer suffix is in order.
    context = np.repeat(np.arange(len(contexts)), sizes + 1)
    room = np.arange(n) - starts[context]
    packed = np.zeros(n, np.uint64)
    for k in range(SYMBOL):
        packed[: n - k] |= (text[k:] & 255).astype(np.uint64) << np.uint64(8 * (SYMBOL - 1 - k))
    # Suffixes that reach their context's end within a symbol differ from all others: their own keys, after the rest.
    ending = np.flatnonzero(sizes[context] - room < SYMBOL)
    key = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    key[ending] = n + np.arange(len(ending))
    order = suffix_array(key, SYMBOL)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    whole = room >= SYMBOL
    symbol = np.zeros(n, np.uint64)
    symbol[np.flatnonzero(whole)] = packed[np.flatnonzero(whole) - SYMBOL]
    bwt, legal = symbol[order], whole[order]
    back = np.full(n, -1, np.int64)
    back[legal] = place[order[legal] - SYMBOL]
    # First and last of the stretch of equal preceding symbols about each suffix: an interval within one needs no splitting.
    change = np.concatenate(([True], (bwt[1:] != bwt[:-1]) | ~legal[1:] | ~legal[:-1]))
    stretch_end = np.append(np.flatnonzero(change)[1:], n)[np.cumsum(change) - 1]
    # Level 1: intervals of suffixes with equal first symbols that lie inside their context.
    inside = (sizes[context] - room >= SYMBOL)[order]
    first = packed[order]
    new = np.concatenate(([True], (first[1:] != first[:-1]) | ~inside[1:] | ~inside[:-1]))
    left = np.flatnonzero(new)
    right = np.append(left[1:], n)
    ok = (right - left > 1) & inside[left]
    left, right = left[ok], right[ok]
    hinted = np.zeros(len(contexts), bool)
    for level in range(1, length // SYMBOL):
        if not len(left):
            break
        if level == hint // SYMBOL:
            hinted[np.unique(context[order[_covered(left, right, n)]])] = True
        plain = legal[left] & (stretch_end[left] >= right)
        nl, nr = [back[left[plain]]], [back[right[plain] - 1] + 1]
        l, r = left[~plain], right[~plain]
        if len(l):  # split by symbol: members with equal symbols go to neighbouring places
            size = r - l
            which = np.repeat(np.arange(len(l)), size)
            member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + l[which]
            keep = legal[member]
            which, member = which[keep], member[keep]
            by = np.lexsort((back[member], which))
            which, member = which[by], member[by]
            sym, to = bwt[member], back[member]
            edge = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (sym[1:] != sym[:-1]))) if len(which) else np.empty(0, bool))
            count = np.diff(np.append(edge, len(which)))
            many = count > 1
            nl.append(to[edge[many]])
            nr.append(to[edge[many]] + count[many])
        left, right = np.concatenate(nl), np.concatenate(nr)
    hit = np.sort(order[_covered(left, right, n)])
    at = context[hit]
    cuts = np.searchsorted(at, np.arange(len(contexts) + 1))
    return [hit[cuts[k] : cuts[k + 1]] - starts[k] for k in range(len(contexts))], hinted


def _covered(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in some interval."""
    flag = np.zeros(n + 1, np.int64)
    np.add.at(flag, left, 1)
    np.add.at(flag, right, -1)
    return np.cumsum(flag)[:-1] > 0


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of the runs of consecutive numbers."""
    if not len(starts):
        return []
    edge = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
    return list(zip(starts[edge].tolist(), starts[np.append(edge[1:], len(starts)) - 1].tolist(), strict=True))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Fewer rows at a time than Spark sends, so that what is made of them stays small."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _texts(docs: DataFrame) -> DataFrame:
    key = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def spans(docs: DataFrame, length: int = 400) -> DataFrame:
    """row, s, e: byte ranges to remove, of the rows that have any; `row` is made of doc_id and the text's hash.
    Rows that only share a string of `HINT` bytes come with a null range."""
    if length % SYMBOL or length < SURE:
        raise ValueError(f"length must be a multiple of {SYMBOL} and at least {SURE}")
    texts = _texts(docs)
    # Equal texts under one id can't be told apart by their row: they are one text here that repeats itself wholly.
    doubled = texts.filter(F.octet_length("text") >= length).groupBy("row").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("e")).filter("n > 1").select("row", F.lit(0).alias("s"), "e")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every context's place and hash, without its bytes."""
        for b in sliced(batches):
            rows, ats, found, keys = [], [], [], []
            for row, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = x.as_py().encode("utf-8", "surrogatepass")
                for anchor, first, last, inside in all_anchors(data):
                    # The last window that has all `length` bytes; before `first` where there is none.
                    last = np.minimum(last, len(data) - length)
                    rows += [row] * len(anchor)
                    ats.append((first, last, inside))
                    found.append(anchor)
                    keys += [xxhash.xxh128_digest(data[s : e + length]) for s, e in zip(first.tolist(), last.tolist(), strict=True)]
            if rows:
                at, to, inside = (np.concatenate([x[k] for x in ats]).astype(np.int32) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(keys, pa.binary()), pa.array(rows, pa.string()), pa.array(at), pa.array(to), pa.array(inside)], names=["anchor", "key", "row", "at", "upto", "inside"])

    found = materialise(texts.select("row", "text").mapInArrow(find, "anchor long, key binary, row string, at int, upto int, inside int"), "repeats-anchors")
    often = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("inside").alias("inside")).filter("n > 1 or inside < 0").select("anchor")
    often = materialise(often, "repeats-often")  # joined as a table, a very frequent anchor's rows can be split
    shared = materialise(found.join(often, "anchor", "left_semi"), "repeats-shared")
    discard(found, often)
    # Equal contexts are one row with their number and one of their places.
    merged = shared.groupBy("anchor", "key").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "upto", "inside")).alias("place"))
    merged = materialise(merged, "repeats-merged")
    # Equal contexts are known to repeat; they matter further only where others, or other places in them, have their anchor.
    more = F.col("place.upto") - F.col("place.at")
    whole = materialise(merged.filter("n > 1").select("anchor", "key", F.when(more >= 0, 0).alias("a"), F.when(more >= 0, more).alias("z")), "repeats-whole")
    several = materialise(merged.groupBy("anchor").agg(F.count("*").alias("different"), F.min("place.inside").alias("least")).filter("different > 1 or least < 0").drop("least"), "repeats-several")
    places = merged.join(several, "anchor").groupBy("place.row").agg(F.collect_list(F.struct("place.at", "place.upto", "place.inside", "anchor", "key", "different")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The contexts' bytes, of one place each."""
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
        for b in batches:
            for x, places in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                data = x.as_py().encode("utf-8", "surrogatepass")
                for k in range(0, len(places), 4096):
                    out = [(p["anchor"], p["key"], p["different"], p["inside"], data[p["at"] : p["upto"] + length]) for p in places[k : k + 4096]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["anchor", "key", "different", "inside", "context"])

    met = materialise(texts.join(places, "row").select("text", "places").mapInArrow(cut, "anchor long, key binary, different long, inside int, context binary"), "repeats-contexts", "zstd")
    discard(merged, several)
    parts = _by_transform(met.filter(F.col("different") <= MAX_GROUP), length).union(_by_hash(met.filter(F.col("different") > MAX_GROUP), length))
    hits = whole.union(parts)
    # a to z: starts, in the context, of repeated strings. Back to the rows that have the context.
    back = shared.select("anchor", "key", "row", "at").join(hits, ["anchor", "key"])
    return back.select("row", (F.col("at") + F.col("a")).alias("s"), (F.col("at") + F.col("z") + length).alias("e")).distinct().union(doubled.select("row", "s", "e"))


def sharing(contexts: list[tuple[int, bytes, int, bytes]]) -> list[tuple[int, bytes, int, bytes]]:
    """Of (anchor, key, inside, context), those that may share a string of `HINT` bytes about the anchor with another:
    the half of it before the anchor or the half behind it, the anchor included. Contexts with it at several places stay."""
    half = (HINT - GRAM) // 2
    sides = [((x[0], x[3][max(0, x[2] - half) : x[2] + GRAM]), (x[0], x[3][x[2] : x[2] + GRAM + half])) for x in contexts]
    before, behind = (Counter(side[k] for side in sides) for k in (0, 1))
    loose = {x[0] for x in contexts if x[2] < 0}
    return [x for x, (a, z) in zip(contexts, sides, strict=True) if x[0] in loose or before[a] > 1 or behind[z] > 1]


def _by_transform(met: DataFrame, length: int) -> DataFrame:
    """anchor, key, a, z of the groups that fit in a task; groups are brought together by a hash of their anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int, bytes]] = []

        def flush(whole: list[tuple[int, bytes, int, bytes]]) -> pa.RecordBatch:
            part = sharing(whole)
            got, hinted = repeated_windows([x[3] for x in part], length) if part else ([], np.empty(0, bool))
            rows = [(x[0], x[1], a, z) for x, starts in zip(part, got, strict=True) for a, z in _runs(starts)]
            rows += [(x[0], x[1], None, None) for x, h, starts in zip(part, hinted, got, strict=True) if h and not len(starts)]
            types = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, types, strict=True)], names=["anchor", "key", "a", "z"])

        total = 0
        for b in batches:
            for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if total >= BATCH_BYTES and x[0] != held[-1][0]:
                    yield flush(held)
                    held, total = [], 0
                held.append(x)
                total += len(x[3])
        if held:
            yield flush(held)

    return met.select("anchor", "key", "inside", "context").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "anchor long, key binary, a int, z int")


def _by_hash(met: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many contexts: strings are counted by a hash of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for anchor, key, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                d = np.frombuffer(c, np.uint8)
                n = max(0, len(c) - length + 1)
                h = gram_hashes(d, HINT)
                x = _mix(h[:n] * _K[0] + h[length - HINT : length - HINT + n] * _K[1])
                y = _mix(h[:n] * _K[1] + h[length - HINT : length - HINT + n] * _K[2])
                # For the hint seven strings about the anchor, numbered below 0.
                at = int(np.flatnonzero(gram_hashes(d).view(np.int64) == anchor)[0])
                about = [k for k in range(at - HINT + GRAM, at + 1, 32) if 0 <= k < len(h)]
                a = np.concatenate((np.arange(n), -1 - np.arange(len(about)))).astype(np.int32)
                x, y = np.concatenate((x, h[about])), np.concatenate((y, np.zeros(len(about), np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * len(a)), pa.array([key] * len(a), pa.binary()), pa.array(a), pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["anchor", "key", "a", "x", "y"])

    each = met.select("anchor", "key", "context").mapInArrow(run, "anchor long, key binary, a int, x long, y long")
    twice = each.groupBy("x", "y").agg(F.count("*").alias("n")).filter("n > 1").select("x", "y")
    a = F.when(F.col("a") >= 0, F.col("a"))
    return each.join(twice, ["x", "y"], "left_semi").select("anchor", "key", a.alias("a"), a.alias("z")).distinct()


def remove(docs: DataFrame, length: int = 400) -> DataFrame:
    """doc_id, n_bytes, kept (binary: the remaining bytes), n_removed, n_spans, longest_repeat, for every row of `docs`.
    longest_repeat: `length` where something is removed, `HINT` where so much was seen to be shared, else 0."""
    cut = spans(docs, length).groupBy("row").agg(F.sort_array(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", "e")))).alias("cut"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for b in sliced(batches):
            rows = []
            for doc, text, cut in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                data, out, done, n = text.as_py().encode("utf-8", "surrogatepass"), [], 0, 0
                upto = -1
                for x in cut or []:
                    if x["s"] > upto:
                        n += 1
                        out.append(data[done : x["s"]])
                    upto = max(upto, x["e"])
                    done = upto
                kept = b"".join([*out, data[done:]])
                rows.append((doc, len(data), len(data) - len(kept), n, length if n else 0 if cut is None else HINT, kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "longest_repeat", "kept"])

    joined = _texts(docs).join(cut, "row", "left").select("doc_id", "text", "cut")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, longest_repeat long, kept binary")
