"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty.

A candidate is a run of key-like characters in a sensitive context (a word such as "key" or "auth" shortly
before it, or in a name that begins the run: of `auth=...` the value is the candidate). Its marginal size is
what zstandard needs for it beyond a dictionary of identifiers and the surrounding text: a repeated or ordinary
name costs few bytes, a random string many. Work is in the row: no shuffle, memory of one text at a time.

Defined results: null and empty texts have no spans; a repeated row is scanned again and gives its own row;
offsets are code points, ends exclusive. Other columns are carried by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")

CONTEXT = re.compile(r"(?i:secret|token|passw|credential|api|key|auth|bearer|private)", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: The '=' after a name with a sensitive word, in a run; the '='s that end base64 are none.
ASSIGNED = re.compile(rf"{CONTEXT.pattern}[A-Za-z0-9_.-]{{0,39}}(=)(?=[^=])", re.ASCII)
#: Words that names in configuration and code are made of: the dictionary that a candidate is measured against.
IDENTIFIERS = (
    "access account action address admin agent api app application archive async auth authorization backend backup "
    "base batch bearer block branch bucket buffer build byte cache callback certificate channel check class client "
    "cloud cluster code column command commit common component config configuration connection console container "
    "content context control cookie count create credentials current custom data database date debug decode default "
    "deploy detail development device digest directory document domain encode encryption endpoint engine entity "
    "environment error event example export field file filter folder format function gateway generate global group "
    "handler hash header health history host identifier image import index input instance interface internal item "
    "job key language layer length level library limit line link list local log login main manager mapping master "
    "member memory message method metric mobile model module monitor name namespace network node number object "
    "offset option order output owner package page parameter parser password path payload permission placeholder "
    "platform plugin policy pool port prefix primary private process product production profile project property "
    "protocol provider proxy public query queue range reader record refresh region register release remote "
    "repository request response result role root route rule sample schedule schema scope script search secret "
    "section security server service session setting signature size source staging state status storage stream "
    "string system table target task template test thread timestamp token trace transaction type update upload url "
    "user username utility value variable version view volume web window worker zone"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the fixed patterns, in that order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found)


def names(identifiers: str, size: int) -> str:
    """So many bytes of names of two to four of the words, in the spellings of code, some with a number."""
    w, out, at, total = identifiers.split(), [], 0, 0
    while total < size:
        part = [w[(at + 89 * i * i + 31 * i) % len(w)] for i in range(2 + at % 3)]
        out.append("_/-. "[at % 5].join(part) + ("", f"{at % 97}", "", f"v{at % 9}.{at % 21}", f"2{at % 10}-0{at % 10}")[at // 5 % 5] + "\n")
        total += len(out[-1])
        at += 1
    return "".join(out)


class Novelty:
    """Marginal compressed bytes of a candidate, given names and the text about it.

    zstandard codes the literals of a short input one byte each, which tells a name from a key by nothing but length.
    So the candidate is measured as the end of a block that names and the surroundings fill, with the words as
    dictionary before it: what the block's compressed size grows by. Its letters are then coded by the names' letter
    frequencies: some 4.5 bits each in a name that is in no dictionary, 6 and more in a random string.
    """

    def __init__(self, around: int = 256, level: int = 3, identifiers: str = IDENTIFIERS, body: int = 6000) -> None:
        import zstandard

        self.around, self.body = around, names(identifiers, body)
        params = zstandard.ZstdCompressionParameters.from_level(level, write_checksum=0, write_content_size=0, write_dict_id=0)
        self.compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "replace")))

    def ratio(self, text: str, start: int, end: int) -> float:
        """Marginal bytes a character. A run without lower-case letters is measured in lower case."""
        run = text[start:end]
        if not any(c.islower() for c in run):
            run = run.lower()
        before = self.body + text[max(0, start - self.around) : start] + "\n" + text[end : end + self.around] + "\n"
        return max(0, self.size(before + run + "\n") - self.size(before)) / max(1, end - start)


def least_novel(run: str, single: float = 0.68, mixed: float = 0.9) -> float:
    """The ratio from which a run is reported: `mixed` if it has letters of both cases, which in names are at the words'
    beginnings only; a long run is held against the bound of its own alphabet."""
    least = mixed if any(c.islower() for c in run) and any(c.isupper() for c in run) else single
    return min(least, 0.9 * bound(run)) if len(run) >= 8 * len(set(run)) else least


def bound(run: str) -> float:
    """Bytes a character that a random string of the run's alphabet takes. The alphabet: the classes that it draws
    on, or only its own characters where it is long enough to show them all."""
    own = set(run)
    n = sum(not (c.isalpha() or c.isdigit()) for c in own) + 10 * any(c.isdigit() for c in own)
    for a, f in ("af", "AF"):
        letters = [c for c in own if c.isalpha() and c.islower() == a.islower()]
        n += (6 if max(letters) <= f else 26) if letters else 0
    return math.log2(min(n, len(own)) if len(run) >= 8 * len(own) else n) / 8


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: Novelty, before: int = 40) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that overlap no fixed span, mix letters and digits, and don't compress."""
    near = [m.end() for m in CONTEXT.finditer(text)]
    found = []
    if not near:
        return found
    starts, furthest = [x[0] for x in taken], list(accumulate((x[2] for x in taken), max))

    def novel(s: int, e: int) -> bool:
        i = bisect_right(near, s)
        if e - s < 16 or not i or s - near[i - 1] > before:
            return False
        k = bisect_left(starts, e)  # of fixed spans that begin before the candidate's end, one that ends after its start
        if k and furthest[k - 1] > s:
            return False
        run = text[s:e]
        if not (any(c.isdigit() for c in run) and any(c.isalpha() for c in run)) or len(set(run)) < 8:
            return False
        return novelty.ratio(text, s, e) >= least_novel(run)

    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        cuts = [x.start(1) for x in ASSIGNED.finditer(m[0])]
        parts = [(s + a, s + b) for a, b in zip([0, *[c + 1 for c in cuts]], [*cuts, e - s], strict=True)] if cuts else []
        found += [(a, 3, b) for a, b in parts if novel(a, b)] or ([(s, 3, e)] if novel(s, e) else [])
    return found


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)


def value_of(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """Of an assignment the value, else the whole span."""
    s, k, e = span
    return (ASSIGN.match(text, s).start(2) if k == 0 else s), e


def marginals(text: str, spans: list[tuple[int, int, int]], novelty: Novelty) -> list[float]:
    """The marginal bytes a character of each span's value, fixed spans' too: what tells a random key that a pattern
    found from a name or a placeholder in its place."""
    return [round(novelty.ratio(text, *value_of(text, x)), 3) for x in spans]


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, marginal array<double>"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base_sha256", pa.string()), ("spans", pa.string()), ("marginal", pa.list_(pa.float64()))])


def find(docs: DataFrame) -> DataFrame:
    """Per row: counts by kind, digest of the fixed spans, all spans, and in their order what each adds in compressed
    bytes a character."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                more = novel_spans(text, base, novelty)
                n = [0, 0, 0, 0]
                for _, k, _ in base + more:
                    n[k] += 1
                spans = sorted(base + more)
                rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), marginals(text, spans, novelty)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(FOUND_ARROW), FOUND_ARROW, strict=True)], schema=FOUND_ARROW)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, FOUND)


def mask(text: str, mark: str = "[SECRET]", novelty: Novelty | None = None) -> str:
    """The text with the union of its spans replaced; of an assignment, the value only."""
    base = base_spans(text)
    spans = [value_of(text, x) for x in base]
    spans += [(s, e) for s, _, e in novel_spans(text, base, novelty or Novelty())]
    out, at = [], 0
    for s, e in sorted(spans):
        if e > at:
            if s >= at:
                out += [text[at:s], mark]
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with the secrets in `text` masked and `n_chars`, if there, counted anew; null texts stay null."""
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            texts = [None if (t := x.as_py()) is None else mask(t, novelty=novelty) for x in b.column(names.index("text"))]
            cols = list(b.columns)
            cols[names.index("text")] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in names:
                field = b.schema.field("n_chars")
                cols[names.index("n_chars")] = pa.array([old.as_py() if t is None else len(t) for t, old in zip(texts, b.column(names.index("n_chars")), strict=True)], field.type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(clean, docs.schema)
