"""Benchmark decontamination by a broadcast hash set of n-grams, in DataFrame functions only.

The test windows' hashes are put into the plan as one literal, a bitmap that every window of a training document is
looked up in (two bits a hash), so the corpus is scanned once, in its own rows, whatever the size of the benchmark: no
window is shuffled unless the bitmap lets it through. What it lets through is joined with the table of test windows on
the window's full text, broadcast where rows and bytes are few, which drops the false hits. The bitmap has 16 bits a window
or more, up to `MAX_BITS`; of a benchmark of over four million windows more false hits go to the join.

Items of equal text are one class, and windows that the same classes hold one group, so a hit names its group
alone, however many items share the window; only at the end does each document's set of groups become items.

Defined results: a null or wordless text has n_words 0 and no hit; null or wordless items have no window;
an item repeated under one id counts once; windows of items without an id count as hits but name no item.
Documents repeated with the same id and text give one row. Empty tables give empty results or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, by_id, let, materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Bits of the literal bitmap: at least, at most. Rows and bytes of windows to be broadcast; and bytes of item ids.
MIN_BITS, MAX_BITS = 1 << 20, 1 << 26
MAX_WINDOWS = 1 << 20
MAX_WINDOW_BYTES = 1 << 26
MAX_ID_BYTES = 1 << 23


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SEPARATORS), lambda w: w != "")


def _starts(w: Column, length: int) -> Column:
    return F.when(F.size(w) >= length, F.sequence(F.lit(1), F.size(w) - (length - 1))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Each different window of `window` words, or a whole text if shorter: len, wtext, h, group. And group, item_ids
    (sorted, as strings): the items that hold a group's windows."""
    w = F.col("w")
    length = F.least(F.size(w), F.lit(window))
    spans = F.transform(F.sequence(F.lit(1), F.size(w) - length + 1), lambda i: F.slice(w, i, length))
    texts = benchmark.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).groupBy("w").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    texts = texts.withColumn("class", F.sha2(F.array_join("w", " "), 256))
    held = (
        texts.select("class", F.explode(spans).alias("g"))
        .select("class", F.size("g").alias("len"), F.array_join("g", " ").alias("wtext"), F.xxhash64("g").alias("h"))
        .distinct()
    )
    held = materialise(held, "decontam-held")
    # The classes that hold a window, by the exclusive or of two hashes, without bringing them together.
    mark = lambda k: F.bit_xor(F.xxhash64("class", F.lit(k))).cast("string")
    grams = materialise(held.groupBy("len", "wtext", "h").agg(F.concat_ws(":", mark(1), mark(2)).alias("group")), "decontam-windows")
    classes = held.join(grams.select("len", "wtext", "group"), ["len", "wtext"]).select("group", "class").distinct()
    items = classes.join(texts.select("class", "ids"), "class").groupBy("group").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("item_ids"))
    return grams, materialise(items, "decontam-items")


def _places(h: Column, bits: int) -> list[Column]:
    """Two places of a hash in a bitmap of so many bits, a power of two: its upper and its lower end."""
    return [F.shiftrightunsigned(h, 65 - bits.bit_length()), h.bitwiseAND(F.lit(bits - 1))]


def bitmap(grams: DataFrame, bits: int) -> Column:
    """The places of all hashes `h` as one literal array of 64-bit words; at most bits / 64 rows come to the driver."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    at = grams.select(F.explode(F.array(*_places(F.col("h"), bits))).alias("at"))
    words_ = ["0"] * (bits // 64)
    for k, word in at.groupBy(F.shiftright("at", 6).alias("k")).agg(F.bit_or(one).alias("word")).collect():
        words_[k] = str(word)
    return F.split(F.lit(",".join(words_)), ",").cast("array<bigint>")  # constant folding makes an array of it


def _found(docs: DataFrame, known: Column, bits: int, lengths: list[int]) -> DataFrame:
    """doc_id, key, n_words, hits (pos, len, wtext): each document scanned in its row against the bitmap."""

    def inside(h: Column) -> Column:
        upper, lower = (F.getbit(F.get(known, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _places(h, bits))
        return upper & lower

    def of_length(w: Column, n: int) -> Column:
        at = F.transform(_starts(w, n), lambda i: F.struct(i.alias("pos"), F.xxhash64(F.slice(w, i, n)).alias("h")))
        return F.transform(F.filter(at, lambda x: inside(x["h"])), lambda x: F.struct(x["pos"].alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(w, x["pos"], n), " ").alias("wtext")))

    def scan(w: Column) -> Column:
        hits = F.concat(*[of_length(w, n) for n in lengths]) if lengths else F.array().cast("array<struct<pos:int,len:int,wtext:string>>")
        return F.struct(F.size(w).cast("long").alias("n_words"), hits.alias("hits"))

    return docs.select("doc_id", F.xxhash64("text").alias("key"), let(words(F.col("text")), scan).alias("r")).select("doc_id", "key", "r.*")


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc_id, n_words, spans (array of pos and len, words from 1), n_hit, item_ids: verified occurrences. The table of
    windows is broadcast up to `max_windows` rows and `MAX_WINDOW_BYTES`."""
    grams, items = benchmark_windows(benchmark, window)
    n, size, lengths = grams.agg(F.count("*"), F.sum(F.octet_length("wtext") + F.octet_length("group") + 64), F.sort_array(F.collect_set("len"))).first()
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (16 * n).bit_length()))
    found = _found(docs, bitmap(grams, bits), bits, lengths).withColumn("x", F.explode_outer("hits"))
    # Documents without hits get a text of their own that no window has, so that they don't meet at one null key.
    text = F.coalesce("x.wtext", F.concat(F.lit("\0"), F.xxhash64("doc_id", "key").cast("string")))
    own = grams.select("group", F.col("wtext").alias("g"))
    every = found.select("doc_id", "key", "n_words", "x", text.alias("t")).join(F.broadcast(own) if n <= max_windows and (size or 0) <= MAX_WINDOW_BYTES else own, F.col("t") == F.col("g"), "left")
    upto = F.col("x.pos") + F.col("x.len") - 1
    every = every.select("doc_id", "key", "n_words", F.when(F.col("g").isNotNull(), F.struct(F.col("x.pos").alias("pos"), upto.alias("upto"))).alias("span"), "group")
    of_doc = every.groupBy("doc_id", "key", "n_words").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.collect_set("group").alias("groups"))
    step = lambda a, x: F.struct(F.greatest(a["upto"], x["upto"]).alias("upto"), (a["total"] + F.greatest(F.lit(0), x["upto"] - F.greatest(a["upto"], x["pos"] - 1))).alias("total"))
    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("upto"), F.lit(0).alias("total")), step, lambda a: a["total"])
    of_doc = materialise(of_doc.withColumn("n_hit", n_hit.cast("long")), "decontam-documents")
    bytes_ = items.agg(F.sum(F.octet_length(F.array_join("item_ids", ",")))).first()[0] or 0
    named = of_doc.select("doc_id", "key", F.explode("groups").alias("group")).join(F.broadcast(items) if bytes_ <= MAX_ID_BYTES else items, "group")
    named = named.select("doc_id", "key", F.explode("item_ids").alias("item_id")).groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    left, right = of_doc.alias("l"), named.alias("r")
    joined = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.key") == F.col("r.key")), "left")
    return joined.select("l.doc_id", "n_words", F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"), "spans", "n_hit")


def judged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, percent: int = 5) -> DataFrame:
    """`hits` with `contaminated`: some word is hit, and at least `percent` in a hundred are."""
    return hits(docs, benchmark, window).withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    bad = judged(docs, benchmark).filter("contaminated").select("doc_id")
    return by_id(docs, bad, "left_anti")
