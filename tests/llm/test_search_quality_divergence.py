"""Quality trees, ranked search and the divergence audit, against brute-force versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from splicelake.llm import divergence, lexical_search, quality_trees, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, item string, key string, term string, x string, score string"
ODD = [
    None, "", "   \n\t ", "one", "One two TWO", "x" * 20_000, "Ünïcode ÉCOLE straße İstanbul 漢字 漢字\x1fa\x85b c", "a b c d e f g h " * 9, "the and of the",
    "same line\nsame line\n\nother\nsame line", " ".join(f"w{i % 977}x{i % 31}" for i in range(20_000)), "!!! ### 123 456", "the and of the",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], *["clash"] * 5) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None if k == 6 else 10_000 + k, t, None if k % 3 == 0 else "en", None if k % 5 == 0 else "odd", *[None] * 5) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], rows[3]], SCHEMA).repartition(3).cache()


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def search_brute(docs, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    counted = [(i, Counter(find(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(find(t))
    out = []
    for item, terms in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms if t in df}
        scored = []
        for i, c, n in counted:
            m = 50 + (50 * n * n_docs) // n_terms
            s = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in w if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("k", "block", "cells"), [(50, 16 << 20, 1 << 21), (3, 400, 300), (1, 16 << 20, 64)])
def test_search(spark, docs, k, block, cells, monkeypatch):
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    rows = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(6).collect()]
    rows += [(None, "the ONE"), (10_001, None), (10_002, "no-such-term zzzz9"), (10_003, "the and"), (10_003, "straße 漢字 of of"), (10_004, "the"), (10_005, "x" * 20_000)]
    items = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "item_id long, text string, rank string, doc_id string")
    got = lexical_search.search(docs, items, k, block).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == search_brute([(r["doc_id"], r["text"]) for r in docs.collect()], rows, k)


def test_search_prunes_frequent_terms(spark):
    """A rare term's k-th impact outweighs what a term of nearly all documents can give: that one makes no candidates."""
    docs = spark.createDataFrame([(i, "the rare" if i % 10 == 0 else "the word") for i in range(400)], "doc_id long, text string")
    terms = ["rare", "the"]
    held = lexical_search.postings(docs, terms)
    stats = lexical_search.term_statistics(held, 5, 400, 800)
    rows = lexical_search.pruned_terms(spark.createDataFrame([(0, 0), (0, 1)], "item long, term int"), stats).collect()
    assert {r["term"]: r["pruned"] for r in rows} == {0: False, 1: True}
    assert lexical_search.ranked(held, lexical_search.Index([tuple(r) for r in rows], 1, 2), 5, 400, 800).groupBy("item").count().first()["count"] <= 5 * held.rdd.getNumPartitions()


def test_search_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one"), ("c", "three")], "doc_id string, text string")
    got = lexical_search.search(docs, spark.createDataFrame([("q", "TWO one")], "item_id string, text string")).orderBy("rank").collect()
    assert [(r["item_id"], r["doc_id"]) for r in got] == [("q", "a"), ("q", "b"), ("q", None)]


def test_search_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(docs.filter("text is null"), items).count() == 0


def audit_brute(rows, least, shown):
    groups, total, of_lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang or "", source or ""].update(words)
        total[lang or ""].update(words)
        of_lang[lang or ""].update(set(words))
    kept = {lang: {t for t, d in c.items() if d >= least} for lang, c in of_lang.items()}

    def shares(counts, lang):
        n, v = sum(counts[t] for t in kept[lang]), len(kept[lang])
        return {t: 1 + 10**9 * (counts[t] + 1) // (n + v) for t in kept[lang]}

    p = {g: shares(c, g[0]) for g, c in groups.items()}
    out = []
    for (lang, source), own in p.items():
        part = lambda name, values, most: [(lang, source, name, item, v, r) for r, (v, _, item) in enumerate(sorted(((-v, i.encode(), i) for i, v in values)), 1) if r <= most]  # noqa: B023, E731
        f = lambda a, b: (a - b) * (a - b) // b
        out += part("pair", [(s, sum(f(own[t], q[t]) for t in own)) for (one, s), q in p.items() if one == lang and s != source], 10**9)
        base = shares(total[lang], lang)
        out += part("term", [(t, f(own[t], base[t])) for t in own if groups[lang, source][t] and own[t] > base[t]], shown)
    return Counter((a, b, c, d, -v, r) for a, b, c, d, v, r in out)


@pytest.mark.parametrize(("least", "shown"), [(3, 200), (1, 5), (10_000, 200)])
def test_divergence(docs, least, shown):
    got = divergence.audit(docs, least, shown).collect()
    assert Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == audit_brute([(r["text"], r["lang"], r["source"]) for r in docs.collect()], least, shown)


def test_divergence_shares_are_exact(spark):
    rows = [(0, 1, 1), (8_999_999_999, 10**10, 5), (9_000_000_000, 10**10, 5), (10**14, 3 * 10**14 + 7, 10**6)]
    got = spark.createDataFrame(rows, "n long, t long, v long").select("n", "t", "v", divergence.share("n", "t", "v").alias("p")).collect()
    assert [r["p"] for r in got] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in rows]


def test_divergence_empty(docs):
    assert divergence.audit(docs.limit(0)).count() == 0
    alone = divergence.audit(docs.filter("text is null").limit(1)).collect()
    assert alone == []


def test_divergence_makes_no_row_for_a_term_that_a_source_lacks(spark, monkeypatch):
    """Forty sources of twenty terms of their own each: a row for each kept term and source would be 32,000."""
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    rows = [(" ".join(word(1000 + 20 * s + k) for k in range(20)) + " shared" * (s % 3), "en", f"s{s}") for s in range(40) for _ in range(3)]
    rows += [("", "en", "mute"), (None, "en", None), ("shared", None, "s0")]
    written, write = [], divergence.materialise
    monkeypatch.setattr(divergence, "materialise", lambda *a: written.append(write(*a)) or written[-1])
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == audit_brute([(t, lang, source) for t, lang, source in rows], 3, 200)
    assert written and sum(df.count() for df in written) < 4_000


def test_divergence_of_sources_with_the_same_terms(spark):
    """Only what two sources both have makes their difference; a far larger one beside them leaves it as it is."""
    rows = [(t, "en", s) for s, t in (("a", "one one two"), ("b", "one two two three"), ("c", "one two " * 5_000)) for _ in range(3)]
    rows += [("only here", "de", "a")] * 3 + [("rare", "fr", "a"), ("", "fr", "b")]
    got = divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).collect()
    assert Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == audit_brute(rows, 3, 200)


def described_brute(text):
    """Some of the statistics, from the text itself."""
    t = text or ""
    words, lines = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], t.split("\n")
    filled = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    over = lambda a, b: a / b if b else 0.0
    return {
        "share_upper": over(sum("A" <= c <= "Z" for c in t), len(t)), "share_digit": over(sum(c in "0123456789" for c in t), len(t)), "share_wide": over(sum(ord(c) > 127 for c in t), len(t)),
        "log_chars": math.log1p(len(t)), "log_words": math.log1p(len(words)), "word_mean": over(sum(map(len, words)), len(words)), "word_longest": max(map(len, words), default=0),
        "words_short": over(sum(len(w) <= 2 for w in words), len(words)), "words_distinct": over(len(set(words)), len(words)), "words_top": over(max(Counter(words).values(), default=0), len(words)),
        "pairs_distinct": over(len(set(zip(words, words[1:]))), len(words) - 1) if len(words) > 1 else 0, "windows_repeated": 1 - len(set(windows)) / len(windows) if windows else 0,
        "line_words": over(len(words), len(filled)), "lines_repeated": 1 - len(set(filled)) / len(filled) if filled else 0, "lines_empty": over(len(lines) - len(filled), len(lines)) if t else 0,
    }


def test_statistics(docs):
    texts = [r["text"] for r in docs.collect()]
    got = quality_trees.statistics(pa.array(["skipped", *texts], pa.string())[1:])
    assert got.shape == (len(texts), len(quality_trees.FEATURES)) and np.isfinite(got).all()
    for text, row in zip(texts, got, strict=True):
        for name, want in described_brute(text).items():
            assert row[quality_trees.FEATURES.index(name)] == pytest.approx(want, rel=1e-5, abs=1e-6), (name, text and text[:40])
    one = np.concatenate([quality_trees.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.array_equal(one, got)


def tree_brute(x, g, h, edges, depth, pull, least):
    """The best tree by trying each edge of each feature on the rows themselves: a leaf's rows, left to right."""
    if not depth:
        return [np.arange(len(x))]
    gains = [
        (g[a].sum() ** 2 / (h[a].sum() + pull) + g[~a].sum() ** 2 / (h[~a].sum() + pull) - g.sum() ** 2 / (h.sum() + pull), -k, -j, a)
        for k, es in enumerate(edges) for j, e in enumerate(es) if (a := x[:, k] <= e) is not None and h[a].sum() >= least and h[~a].sum() >= least
    ]
    top = max(gains, key=lambda t: t[:3], default=(0,))
    a = top[3] if top[0] > 1e-9 else np.ones(len(x), bool)
    left, right = np.flatnonzero(a), np.flatnonzero(~a)
    return [*[left[r] for r in tree_brute(x[left], g[left], h[left], edges, depth - 1, pull, least)], *[right[r] for r in tree_brute(x[right], g[right], h[right], edges, depth - 1, pull, least)]]


def test_trees_by_brute_force():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 4)), 1).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] + 0.3 * rng.normal(size=400) > 0)).astype(float)
    model = quality_trees.fit(x, y, trees=4, depth=3, bins=16, rate=0.3)
    raw, edges = np.full(400, model.base), quality_trees.bin_edges(x, 16)
    for _ in range(4):
        p = quality_trees.logistic(raw)
        g, h = y - p, p * (1 - p)
        for rows in tree_brute(x, g, h, edges, 3, quality_trees.PULL, quality_trees.LEAST):
            raw[rows] += 0.3 * g[rows].sum() / (h[rows].sum() + quality_trees.PULL)
    assert np.allclose(model.raw(x), raw)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_trees_of_one_class_or_none():
    x = np.zeros((3, len(quality_trees.FEATURES)), np.float32)
    assert quality_trees.fit(x[:0], np.zeros(0)).score(x) == pytest.approx(0.5)
    assert (quality_trees.fit(x, np.ones(3)).score(x) > 0.8).all()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_held_out(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = {r["doc_id"]: r for r in queries.op11_quality_trees(spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    pairs = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [p for q, p in pairs if q == 1], [p for q, p in pairs if q == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.3 * len(bad) + 1


def test_quality_reads_no_held_out_label(spark):
    folder = f"{SF}"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    flipped = labels.withColumn("quality", F.when(fold == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).filter(fold != 0)
    a = {r["doc_id"]: r["score"] for r in queries.op11_quality_trees(spark, folder).collect()}
    b = {r["doc_id"]: r["score"] for r in quality_trees.score(docs, flipped).collect()}
    assert a == b


def test_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1, "x"), (0, 0, "x"), (1, 1, None), (None, 0, None), (2, None, None), (10_001, 0, None)], "doc_id long, quality int, score string")
    got = quality_trees.score(docs, labels, max_rows=2).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in quality_trees.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_trees.score(docs.limit(0), labels).count() == 0
