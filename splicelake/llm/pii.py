"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that give them away.

The values that the patterns find are the protected entities, and so are the classes they belong to: the domain of an
address, the network of an ip (three parts), the issuer of a card (six digits), the country and area of a phone (four
digits). A class gathers support that its values, each in a text or two, don't have. A term discloses an entity as far as seeing the
term makes the entity likelier: with documents counted whole and over the whole corpus, the disclosure of e by t is
PMI(e; t) / IC(e), that is log(p(e|t) / p(e)) / -log p(e): 1 if t occurs only with e, 0 if they are independent.
Candidates are pairs that stand close together in enough different texts. Terms at or over a threshold are removed
(generalised to a mark) wherever they occur, also in documents that don't print the entity.

Three passes: one finds entities and the terms about them; one counts, over all documents, the candidate terms and
pairs; one marks the disclosing terms. In the latter two Bloom filters pick them in the row, and the exact join after
it drops their false hits. Filters have 16 bits a key; of more candidates than `FILTER_BYTES` can hold, the terms are
dealt into parts, each with its pass.

Defined results: null and empty texts have no spans; repeated rows give a row each, but exact copies of a
text count once as support. Offsets are code points, ends exclusive. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Starting only where a run of digits starts, and never giving digits back, finds the same as trying each digit, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Words of four letters or more, and shorter ones with a capital, as names have.
WORD = re.compile(r"[^\W\d_]{4,}|(?<![^\W\d_])[A-Z\u00C0-\u00DE][^\W\d_]{1,2}(?![^\W\d_])")
#: Bytes of a Bloom filter: at least, at most.
ADDRESS_BYTES, FILTER_BYTES = 1 << 16, 1 << 24
#: Pairs of an entity and a term about it that one row carries; a text with more has further rows.
NEAR_ROWS = 4096


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: for each @, the run of local characters before it (after the last match), then the domain."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in LOCAL:
            s -= 1
        if s < at and (m := DOMAIN.match(text, at + 1)):
            found.append((s, m.end()))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end), in that order."""
    found = [(s, 0, e) for s, e in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _key(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


def entity(kind: int, value: str) -> int:
    """The same person's value under any spelling: case of an address, separators of a number."""
    plain = value.lower() if kind == 0 else value if kind == 1 else re.sub(r"[^0-9]", "", value)
    return _key(f"{KINDS[kind]}:{plain}")


def group(kind: int, value: str) -> int:
    """The class of a value: domain, network, issuer, or country and area."""
    digits = re.sub(r"[^0-9]", "", value)
    of = value.rpartition("@")[2].lower() if kind == 0 else value.rpartition(".")[0] if kind == 1 else digits[: 6 if kind == 2 else 4]
    return _key(f"{KINDS[kind]} of:{of}")


def protected(text: str, span: tuple[int, int, int], classes: bool) -> list[int]:
    s, k, e = span
    return [entity(k, text[s:e]), group(k, text[s:e])] if classes else [entity(k, text[s:e])]


def context(text: str, spans: list[tuple[int, int, int]], reach: int, classes: bool = False) -> list[tuple[int, int]]:
    """(entity or class, term) of the terms within `reach` characters of an entity, cut at no word and inside no entity."""
    out, inside = set(), Inside(spans)
    for s, k, e in spans:
        whom = protected(text, (s, k, e), classes)
        for m in WORD.finditer(text, max(0, s - reach), min(len(text), e + reach)):
            a, b = m.span()
            if (a and text[a - 1].isalpha()) or (b < len(text) and text[b].isalpha()) or inside(a, b):
                continue
            term = _key(m[0].lower())
            out.update((who, term) for who in whom)
    return sorted(out)


class Inside:
    """Whether a stretch shares a character with one of the spans, by one search."""

    def __init__(self, spans: list[tuple[int, int, int]]) -> None:
        self.starts, self.furthest = [x[0] for x in spans], list(accumulate((x[2] for x in spans), max))

    def __call__(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.furthest[k - 1] > a


SCANNED = "doc_id long, row string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, text_key long, near array<struct<entity:long,term:long>>, further boolean"
_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row, text; rows of one id and text have one `row`, and the same spans."""
    row = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text").cast("string"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text")


def scan(docs: DataFrame, reach: int = 60, classes: bool = True) -> DataFrame:
    """Per row, what the patterns find, and the terms about it; of very many such pairs the rest in further rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "row", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "text_key", "near", "further"]
        types = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), _NEAR, pa.bool_()]
        for b in batches:
            rows = []
            for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py() or ""
                spans = base_spans(text)
                n = Counter(k for _, k, _ in spans)
                all_, key = joined(spans), _key(text) if spans else 0
                near = [{"entity": w, "term": t} for w, t in context(text, spans, reach, classes)] if spans else []
                rows.append((doc, row, n[0], n[1], n[2], n[3], hashlib.sha256(all_.encode()).hexdigest(), all_, key, near[:NEAR_ROWS], False))
                rows += [(doc, row, 0, 0, 0, 0, "", "", key, near[k : k + NEAR_ROWS], True) for k in range(NEAR_ROWS, len(near), NEAR_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 11, types, strict=True)], names=names)

    return _rows(docs).mapInArrow(run, SCANNED)


def _bits(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    u = keys.astype(np.int64).view(np.uint64)
    return u % np.uint64(size * 8), (u >> np.uint64(32)) % np.uint64(size * 8)


def filter_bytes(keys: int) -> int:
    """Two bytes a key, as a power of two within the bounds."""
    return min(FILTER_BYTES, max(ADDRESS_BYTES, 1 << (2 * keys).bit_length()))


def picked(keys: DataFrame, size: int) -> np.ndarray:
    """A Bloom filter of `size` bytes of the one column of `keys`; its words of 8 bytes come to the driver, once each."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(size // 8, np.uint64)
        for b in batches:
            for at in _bits(b.column(0).to_numpy(), size):
                np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(words[at].view(np.int64))], names=["at", "bits"])

    filled = keys.mapInArrow(fill, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 8, "<i8")
    words[filled.column("at").to_numpy()] = filled.column("bits").to_numpy()
    return words.view(np.uint8)


def _hits(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    hit = np.ones(len(keys), bool)
    for at in _bits(keys, len(bits)):
        hit &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return hit


def documents_with(docs: DataFrame, pairs: DataFrame, classes: bool = True) -> DataFrame:
    """entity (null: any), term, n: documents of the whole corpus that hold each candidate term, and each candidate
    entity and term anywhere in them; and what else the filters let through. Added up batch by batch."""
    n = pairs.count()
    parts = -(-2 * n // FILTER_BYTES)
    if parts <= 1:
        return _documents_with(docs, pairs, n, classes)
    # A term is counted in its own part alone, whatever the filters of others let through.
    part = F.pmod(F.xxhash64("term"), F.lit(parts))
    counted = [materialise(_documents_with(docs, pairs.filter(part == k), n // parts, classes).filter(part == k), "pii-part") for k in range(parts)]
    return reduce(DataFrame.union, counted)


def _documents_with(docs: DataFrame, pairs: DataFrame, n: int, classes: bool) -> DataFrame:
    size, both_ = filter_bytes(n), F.col("entity").bitwiseXOR(F.col("term")).alias("pair")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(picked(pairs.select(c), size) for c in ("term", "entity", both_)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, whom, together = sent.value
        for b in batches:
            df: Counter = Counter()
            both: Counter = Counter()
            for text in b.column(0):
                text = text.as_py() or ""
                words = list({w.lower() for w in WORD.findall(text)})
                keys = np.unique(np.fromiter(map(_key, words), np.int64, len(words)))
                keys = keys[_hits(terms, keys)]
                if not len(keys):
                    continue
                df.update(keys.tolist())
                who = np.unique(np.fromiter((w for span in base_spans(text) for w in protected(text, span, classes)), np.int64))
                for e in who[_hits(whom, who)].tolist():
                    both.update((e, t) for t in keys[_hits(together, keys ^ e)].tolist())
                    if len(both) > 200_000:
                        yield _counts(both)
                        both.clear()
            both.update({(None, t): n for t, n in df.items()})
            yield _counts(both)

    return docs.select("text").mapInArrow(count, "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("n"))


def _counts(c: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in c], pa.int64()), pa.array([k[1] for k in c], pa.int64()), pa.array(list(c.values()), pa.int64())], names=["entity", "term", "n"])


def disclosing(docs: DataFrame, scanned: DataFrame, threshold: float = 0.8, support: int = 3, classes: bool = True) -> DataFrame:
    """entity, term, disclosure: the pairs at or over the threshold."""
    near = scanned.select("text_key", F.explode("near").alias("x")).select("text_key", "x.*")
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("text_key").alias("texts")).filter(F.col("texts") >= support).select("entity", "term")
    pairs = materialise(pairs, "pii-pairs")
    if pairs.isEmpty():
        return pairs.withColumn("disclosure", F.lit(0.0))
    holds = scanned.select("row", F.explode(F.array_distinct("near.entity")).alias("entity")).groupBy("entity").agg(F.count_distinct("row").alias("n_entity"))
    counted = materialise(documents_with(docs, pairs, classes), "pii-counts")
    both = counted.filter("entity is not null").withColumnRenamed("n", "both")
    df = counted.filter("entity is null").select("term", F.col("n").alias("df"))
    total = docs.agg(F.greatest(F.count("*"), F.lit(2)).alias("n_docs"))
    p_entity = F.least(F.lit(1.0), F.greatest("n_entity", "both") / F.col("n_docs"))
    given = F.least(F.lit(1.0), F.col("both") / F.greatest("df", "both"))
    # A one-row total, and an entity in every document, which nothing can disclose.
    scored = pairs.join(both, ["entity", "term"]).join(holds, "entity").join(df, "term").join(F.broadcast(total), F.lit(True))
    score = F.when(p_entity >= 1, F.lit(0.0)).otherwise(F.log(given / p_entity) / -F.log(p_entity))
    return scored.withColumn("disclosure", score).filter(F.col("disclosure") >= threshold).select("entity", "term", "disclosure")


def occurrences(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """row, a, b: where the words of `terms` (term) stand, outside the fixed spans."""
    sent = docs.sparkSession.sparkContext.broadcast(picked(terms, filter_bytes(terms.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for b in batches:
            out = []
            for row, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                words = list({w.lower() for w in WORD.findall(text)})
                keys = np.fromiter(map(_key, words), np.int64, len(words))
                hit = _hits(bits, keys)
                if not hit.any():
                    continue
                known, inside = dict(zip(np.array(words, object)[hit].tolist(), keys[hit].tolist(), strict=True)), Inside(base_spans(text))
                out += [(row, t, *m.span()) for m in WORD.finditer(text) if (t := known.get(m[0].lower())) is not None and not inside(*m.span())]
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["row", "term", "a", "b"])

    return _rows(docs).select("row", "text").mapInArrow(run, "row string, term long, a int, b int").join(terms, "term", "left_semi").select("row", "a", "b")


def find(docs: DataFrame, reach: int = 60, threshold: float = 0.8, support: int = 3, classes: bool = True, by_row: bool = False) -> DataFrame:
    """Per row: counts by kind, digest of the fixed spans, and all spans with the terms' that disclose a value or, with
    `classes`, a class of values."""
    scanned = materialise(scan(docs, reach, classes), "pii-scan")
    bad = materialise(disclosing(docs, scanned, threshold, support, classes).select("term").distinct(), "pii-terms")
    scanned = scanned.filter("not further")
    terms = occurrences(docs, bad).groupBy("row").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("terms"))
    base = F.transform(
        F.filter(F.split("base", ","), lambda x: x != ""),
        lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]).alias("k"), x.alias("t")),
    )
    more = F.transform(F.coalesce("terms", F.array().cast("array<struct<a:int,b:int>>")), lambda x: F.struct(x["a"].alias("s"), F.lit(5).cast("long").alias("k"), F.concat(F.lit("term:"), x["a"], F.lit(":"), x["b"]).alias("t")))
    spans = F.array_join(F.transform(F.sort_array(F.concat(base, more)), lambda x: x["t"]), ",")
    return scanned.join(terms, "row", "left").select(
        *(["row"] if by_row else []), "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"), "base_sha256",
        F.when(F.col("terms").isNull(), F.col("base")).otherwise(spans).alias("spans"),
    )


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """`docs` with every span of `text` generalised to its kind's mark, and `n_chars`, if there, counted anew. Rows of
    one id each have their own text's spans; null texts stay null."""
    names, row = docs.columns, F.concat_ws("-", F.coalesce(F.col("d.doc_id").cast("string"), F.lit("")), F.xxhash64("d.text").cast("string"))
    found = find(docs, by_row=True, **options).filter(F.col("spans") != "").groupBy("row").agg(F.max("spans").alias("spans"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, spans in zip(b.column(names.index("text")), b.column(len(names)).to_pylist(), strict=True):
                text, out, done = text.as_py(), [], 0
                for x in (spans or "").split(",") if spans and text else []:
                    kind, s, e = x.split(":")
                    if int(e) > done:
                        if int(s) >= done:
                            out += [text[done : int(s)], f"[{kind.upper()}]"]
                        done = int(e)
                texts.append("".join([*out, text[done:]]) if text is not None else None)
            cols = list(b.columns[: len(names)])
            cols[names.index("text")] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    joined_ = docs.alias("d").join(found.alias("f"), row == F.col("f.row"), "left").select("d.*", F.col("f.spans"))
    return joined_.mapInArrow(clean, docs.schema)
