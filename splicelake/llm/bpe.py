"""BPE encoding and decoding by tree concatenation.

A text of up to `leaf` characters is encoded where it is read: ASCII white space always ends a token of this
vocabulary's pre-tokeniser, so the runs between are encoded each on its own (and kept in a bounded cache). A
longer text is a tree, cut near the middle again and again, inside a word if need be: its leaves are encoded
apart (as rows of their own, so in parallel over the cluster), and at each join a growing window is encoded
anew until it agrees with both sides: left and right of the window there must be a token boundary at which the
window's tokens and the side's tokens coincide, before and after. A sequence all of whose neighbouring pairs
occur in an encoding is the encoding itself, so the spliced ids are exact; if no window agrees, the window has
grown to the whole text, which is exact too.

Defined results: null is the empty text; it has no ids and decodes to the empty text. Repeated rows each
give a row. Rows with the same doc_id don't mix: leaves are brought together by row, not by doc_id.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 8192
CACHE = 400_000
#: Characters of the longest run that is kept.
KEPT_LENGTH = 100
RUN = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Characters at either end of a leaf that are kept as tokens with places.
EDGE = 96
#: Of the added tokens: a cut inside one would spell it out.
SPECIAL_REACH = 32

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The vocabulary at `path`, without truncation and padding; one a process."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


Tokens = list[tuple[int, int, int]]  # id, start, end: in characters of the text


def encode_flat(t, text: str, at: int = 0) -> Tokens:
    e = t.encode(text, add_special_tokens=False)
    return [(i, a + at, b + at) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]


def _letters(text: str, a: int, b: int) -> bool:
    return b > a and text[a:b].isalpha()


def _clean(t: Tokens, i: int) -> bool:
    """Neither token about the boundary before i shares characters with another (as parts of one character do)."""
    return t[i - 1][2] == t[i][1] and t[i - 1][1] < t[i - 1][2] and t[i][1] < t[i][2]


def splice(t, text: str, left: Tokens, right: Tokens, cut: int, first: int, last: int, origin: int = 0, window: int = 64) -> Tokens:
    """Tokens from place `first` to `last`, from those before and after `cut`. `text` stands at `origin`."""
    while True:
        a, b = max(first, cut - window), min(last, cut + window)
        if a == first and b == last:
            return encode_flat(t, text[first - origin : last - origin], first)
        mid = encode_flat(t, text[a - origin : b - origin], a)
        pairs = {(mid[i - 1], mid[i]): i for i in range(1, len(mid)) if _clean(mid, i) and _letters(text, mid[i - 1][1] - origin, mid[i][2] - origin)}
        i = j = None
        if a == first:
            i, head = 0, []
        else:
            for k in range(len(left) - 2, 0, -1):  # the last token of a side has the mark of a word's end
                if left[k][1] < a:
                    break
                if left[k][2] < cut and (left[k - 1], left[k]) in pairs:
                    i, head = pairs[left[k - 1], left[k]], left[:k]
                    break
        if b == last:
            j, tail = len(mid), []
        else:
            for k in range(2, len(right) - 1):
                if right[k][2] >= b:
                    break
                if right[k - 1][1] > cut and (right[k - 1], right[k]) in pairs and pairs[right[k - 1], right[k]] + 1 < len(mid):
                    j, tail = pairs[right[k - 1], right[k]], right[k:]
                    break
        if i is not None and j is not None and i <= j:
            return [*head, *mid[i:j], *tail]
        window *= 2


def cut_at(text: str, first: int, last: int) -> int:
    """A place near the middle between two plain letters, outside anything that could be an added token."""
    middle = (first + last) // 2
    for step in range((last - first) // 4):
        for c in (middle - step, middle + step):
            if first < c < last and text[c - 1 : c + 1].isalpha() and not unicodedata.combining(text[c]) and "<|" not in text[max(first, c - SPECIAL_REACH) : c + SPECIAL_REACH]:
                return c
    return first


def pieces(text: str, leaf: int = LEAF) -> list[tuple[int, int]]:
    """The leaves of the tree over a long text."""
    todo, out = [(0, len(text))], []
    while todo:
        a, b = todo.pop()
        c = cut_at(text, a, b) if b - a > leaf else a
        if c == a:
            out.append((a, b))
        else:
            todo += [(c, b), (a, c)]
    return out


class Leaf(NamedTuple):
    """An encoded stretch of a text. Its edges are kept as tokens with places, for joins; what lies between them,
    from white space to white space, as ids alone. A stretch without such a middle is all head (`middle` None)."""

    head: Tokens
    middle: np.ndarray | None
    tail: Tokens


def edges(text: str) -> tuple[int, int]:
    """Where a stretch's head ends and its tail begins: at white space; (length, length) if it has no middle."""
    first = SPACE.search(text, EDGE)
    last = max((m.start() for m in SPACE.finditer(text, max(0, len(text) - 4 * EDGE), max(0, len(text) - EDGE))), default=-1)
    return (first.start(), last) if first and last > first.start() else (len(text), len(text))


def leaves_of(enc: Encoder, texts: list[str], places: list[int]) -> list[Leaf]:
    """The leaves of these stretches, each of which stands at its place in its whole; their runs are learnt together."""
    cuts = [edges(x) for x in texts]
    found = [RUN.findall(x, *cut) if cut[0] < len(x) else [] for x, cut in zip(texts, cuts, strict=True)]
    enc.learn(set().union(*found))
    out = []
    for x, at, (first, last), runs in zip(texts, places, cuts, found, strict=True):
        head = encode_flat(enc.t, x[:first], at)
        if first == len(x):
            out.append(Leaf(head, None, []))
            continue
        ids = " ".join([y[1] for y in enc.get(runs)])
        middle = np.fromstring(ids, np.uint32, sep=" ") if ids else np.empty(0, np.uint32)
        out.append(Leaf(head, middle, encode_flat(enc.t, x[last:], at + last)))
    return out


class Side(NamedTuple):
    """Joined leaves: where it begins and ends, its edges (text, place, tokens), and the ids between; one edge and no ids
    if there was no white space to part them."""

    first: int
    last: int
    head: tuple[str, int, Tokens]
    middle: list[np.ndarray] | None
    tail: tuple[str, int, Tokens]


def side(x: Leaf, text: str, at: int) -> Side:
    first, last = edges(text)
    head = text[:first], at, x.head
    return Side(at, at + len(text), head, None, head) if x.middle is None else Side(at, at + len(text), head, [x.middle], (text[last:], at + last, x.tail))


def join(t, x: Side, y: Side) -> Side:
    """Neighbours joined: the edges that meet are spliced by a growing window."""
    text, at = x.tail[0] + y.head[0], x.tail[1]
    edge = text, at, splice(t, text, x.tail[2], y.head[2], y.first, at, at + len(text), at)
    ids = np.array([k[0] for k in edge[2]], np.uint32)
    if x.middle is None and y.middle is None:
        return Side(x.first, y.last, edge, None, edge)
    if x.middle is None:
        return Side(x.first, y.last, edge, y.middle, y.tail)
    if y.middle is None:
        return Side(x.first, y.last, x.head, x.middle, edge)
    return Side(x.first, y.last, x.head, [*x.middle, ids, *y.middle], y.tail)


def join_tree(t, parts: list[Side]) -> list[int]:
    """Neighbours joined pair by pair until one part is left; its ids."""
    while len(parts) > 1:
        up = [join(t, parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)]
        parts = up + parts[len(up) * 2 :]
    if not parts:
        return []
    head, tail = ([k[0] for k in edge[2]] for edge in (parts[0].head, parts[0].tail))
    return head if parts[0].middle is None else [*head, *np.concatenate(parts[0].middle).tolist(), *tail]


def encode_tree(path: str, text: str, size: int = LEAF) -> list[int]:
    """A whole text in one process: the same tree, for tests and small tables."""
    enc, parts = encoder(path), pieces(text, size)
    made = leaves_of(enc, [text[a:b] for a, b in parts], [a for a, _ in parts])
    return join_tree(enc.t, [side(x, text[a:b], a) for x, (a, b) in zip(made, parts, strict=True)])


class Encoder:
    """Ids of runs. The first `keep` ones that a process meets, the frequent ones among them, stay; later ones last a batch.

    A Python process outlives its task and its stage, so what it keeps is taken from the memory of the stages that follow.

    New runs that are one word of letters, with a full stop or comma at most, are encoded in one call, parted by
    spaces: each is then one pre-token, so its ids end with the first id that bears the mark of a word's end.
    """

    def __init__(self, path: str, keep: int = CACHE) -> None:
        self.t, self.cache, self.keep = tokenizer(path), {}, keep
        self.late: dict[str, tuple[int, str, str]] = {}
        self.tokens = [self.t.id_to_token(i) or "" for i in range(self.t.get_vocab_size())]
        self.numbers = [str(i) for i in range(len(self.tokens))]
        self.ends = [x.endswith("</w>") for x in self.tokens]
        self.points = {p: self._one(p) for p in ".,"}

    def _one(self, run: str) -> tuple[int, str, str]:
        ids = self.t.encode(run, add_special_tokens=False).ids
        return len(ids), " ".join(map(str, ids)), self.t.decode(ids, skip_special_tokens=False) if ids else ""

    def _words(self, words: list[str]) -> None:
        ids, tokens, ends, got, start = self.t.encode(" ".join(words), add_special_tokens=False).ids, self.tokens, self.ends, [], 0
        for k, i in enumerate(ids):
            if ends[i]:
                own = ids[start : k + 1]
                got.append((len(own), " ".join(map(str, own)), " ".join([tokens[x] for x in own])))
                start = k + 1
        if len(got) != len(words) or start != len(ids):  # a letter whose lower case isn't letters alone
            got = map(self._one, words)
        self.new.update(zip(words, got, strict=True))

    def learn(self, runs: set[str]) -> None:
        cache = self.cache
        self.late = {}
        if not (todo := [r for r in runs if r not in cache]):
            return
        new = self.new = self.late if len(cache) + 2 * len(todo) > self.keep else cache  # a word and its point make two
        plain, other = {}, []
        for r in todo:
            if len(r) > KEPT_LENGTH:
                other.append(r)
            elif r.isalpha():
                plain[r] = r
            elif r[-1] in ".," and r[:-1].isalpha():
                plain[r] = r[:-1]
            else:
                other.append(r)
        if words := [w for w in set(plain.values()) if w not in cache]:
            self._words(words)
        for r, w in plain.items():
            if r is not w:
                (n, ids, text), (m, more, point) = cache.get(w) or new[w], self.points[r[-1]]
                new[r] = (n + m, f"{ids} {more}", f"{text} {point}")
        for r in other:
            (new if len(r) <= KEPT_LENGTH else self.late)[r] = self._one(r)

    def get(self, runs: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text) of each of the runs last learned, less those without ids."""
        cache, late = self.cache, self.late
        if late:
            return [x for r in runs if (x := cache.get(r) or late[r])[0]]
        return [x for r in runs if (x := cache[r])[0]]


def encoder(path: str, keep: int = CACHE) -> Encoder:
    """One a process, kept from task to task."""
    key = f"encoder:{keep}:{path}"
    if key not in _loaded:
        _loaded[key] = Encoder(path, keep)
    return _loaded[key]


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
ENCODED = "doc_id long, n_tokens long, ids array<int>, decoded string"


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def _assemble(parts: list[tuple[int, str, str]], digests: bool) -> tuple:
    n, ids, text = sum(p[0] for p in parts), " ".join(p[1] for p in parts), " ".join(p[2] for p in parts)
    return (n, _sha(ids), _sha(text)) if digests else (n, np.fromstring(ids, np.int32, sep=" "), text)


def encode(docs: DataFrame, path: str, digests: bool = False, size: int = LEAF, keep: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, and `ids` and `decoded`, or their digests. `keep`: runs that a Python process keeps, some 400 bytes each.

    Texts of up to `size` characters are encoded where they are read. A longer one is a tree: each leaf is a row,
    dealt out evenly over the cluster, and the leaves meet by their row's key to be joined. Only one text is ever
    together.
    """
    base = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(text, '') text")
    is_long = F.char_length("text") > size
    schema = DIGESTS if digests else ENCODED
    arrow = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *([("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] if digests else [("ids", pa.list_(pa.int32())), ("decoded", pa.string())])])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, keep)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                s = b.slice(at, 1000)
                rows = []
                for k in range(0, s.num_rows, 50):
                    found = [RUN.findall(x) for x in s.column(1).slice(k, 50).to_pylist()]
                    enc.learn(set().union(*found))
                    rows += [(d, *_assemble(enc.get(runs), digests)) for d, runs in zip(s.column(0).slice(k, 50).to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each leaf of a text."""
        out = pa.schema([("row", pa.string()), ("doc_id", pa.int64()), ("a", pa.int32()), ("text", pa.string())])
        for b in batches:
            for d, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = x.as_py()
                rows = [(k, d, a, text[a:e]) for a, e in pieces(text, size)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, names = encoder(path, keep), ["row", "doc_id", "a", "text", "middle", "ids", "starts", "ends", "n_head", "n", "first"]
        for b in batches:
            for k in range(0, b.num_rows, 20):
                some = b.slice(k, 20)
                texts = some.column(3).to_pylist()
                made, cuts = leaves_of(enc, texts, some.column(2).to_pylist()), [edges(x) for x in texts]
                # The middle's text has done its part.
                kept = [x if y.middle is None else x[:first] + x[last:] for x, y, (first, last) in zip(texts, made, cuts, strict=True)]
                tokens = [[*y.head, *y.tail] for y in made]
                cols = [pa.array(kept, pa.string()), pa.array([None if y.middle is None else y.middle.tobytes() for y in made], pa.binary()), *(pa.array([[z[i] for z in x] for x in tokens], pa.list_(pa.int32())) for i in range(3))]
                counts = [pa.array(x, pa.int32()) for x in ([len(y.head) for y in made], [len(x) for x in texts], [first for first, _ in cuts])]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], *cols, *counts], names=names)

    def whole_text(t, numbers: list[str], rows: list[dict]) -> tuple:
        parts = []
        for r in rows:
            tokens = list(zip(r["ids"], r["starts"], r["ends"], strict=True))
            a, h = r["a"], r["n_head"]
            head = r["text"][: r["first"]], a, tokens[:h]
            tail = r["text"][r["first"] :]
            if r["middle"] is None:
                parts.append(Side(a, a + r["n"], head, None, head))
            else:
                parts.append(Side(a, a + r["n"], head, [np.frombuffer(r["middle"], np.uint32)], (tail, a + r["n"] - len(tail), tokens[h:])))
        ids = join_tree(t, parts)
        part = (len(ids), " ".join([numbers[i] for i in ids]), t.decode(ids, skip_special_tokens=False) if ids else "")
        return (rows[0]["doc_id"], *_assemble([part], digests))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts from their leaves, which come one after the other; the last text of a batch may go on in the next."""
        t, numbers, held, out = tokenizer(path), encoder(path, keep).numbers, [], []
        for b in batches:
            for k in range(0, b.num_rows, 100):
                for r in b.slice(k, 100).to_pylist():
                    if held and r["row"] != held[0]["row"]:
                        out.append(whole_text(t, numbers, held))
                        held = []
                    held.append(r)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(whole_text(t, numbers, held), arrow, strict=True)], schema=arrow)

    key = F.concat_ws("-", F.spark_partition_id(), F.monotonically_increasing_id())
    parts_schema = "row string, doc_id long, a int, text string"
    long = (
        base.filter(is_long)
        .select("doc_id", key.alias("row"), "text")
        .mapInArrow(split, parts_schema)
        .repartition("row", "a")
        .mapInArrow(leaves, parts_schema + ", middle binary, ids array<int>, starts array<int>, ends array<int>, n_head int, n int, first int")
        .repartition("row")
        .sortWithinPartitions("row", "a")
        .mapInArrow(meet, schema)
    )
    return base.filter(~is_long).mapInArrow(whole, schema).unionByName(long)
