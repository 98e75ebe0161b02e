"""The pipeline against the operators' brute-force versions, stage by stage."""

import corpus_pipeline
import pyarrow as pa
from splicelake.llm import bpe, queries, secrets
from splicelake.llm.common import materialise

from .test_operators import SF, components, crc, dense_scores, hits_brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in at.select("doc_id", "text").collect()}
        after = materialise(stage(spark, at, SF), f"test-{name}")
        kept = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name != "bpe":
            assert after.columns == docs.columns and [t for _, t in after.dtypes] == [t for _, t in docs.dtypes]
            got = {r["doc_id"]: r["text"] for r in after.select("doc_id", "text").collect()}
        if name == "toxicity":
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            scores = dense_scores(docs, labels, {r["doc_id"]: r["toxic"] for r in labels.collect() if crc(r["doc_id"]) % 4 != 2})
            assert kept == {d for d in before if scores[d] < 0.3}
        elif name == "near_dedup":
            assert kept == {d for d, (_, c) in components(before, 5).items() if c == d}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert kept == {d for d, (n, hit, _) in hits_brute(before, items).items() if not (hit and 20 * hit >= n)}
        elif name == "secrets":
            assert got == {d: secrets.mask(t) for d, t in before.items()}
        elif name == "bpe":
            t = bpe.tokenizer(queries.vocabulary())
            rows = {r["doc_id"]: r for r in after.collect()}
            for d, x in before.items():
                ids = t.encode(x, add_special_tokens=False).ids
                assert list(rows[d]["ids"]) == ids and rows[d]["decoded"] == t.decode(ids, skip_special_tokens=False)
        at = after
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(kept)


def test_empty(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        at = materialise(stage(spark, at, SF), f"test-{name}")
        assert at.count() == 0


def test_odd_rows(spark):
    """Null and empty texts, repeated rows, rows of one id or none, a very long text: by the docstrings of the stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [
        (20_001, None), (20_002, ""), (20_003, "one"), (20_003, "one"), (None, "alone without an id it is"), (20_004, "some words of the first text of an id here"),
        (20_004, "and quite other words in the second text of that id"), (20_005, " ".join(f"w{k}" for k in range(30_000))), (20_006, "password = hunter22 zq"),
    ]
    rows = [(i, t, None if k % 2 else "en", None, None if t is None else len(t)) for k, (i, t) in enumerate(odd)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    at = docs.unionByName(more.select(*[more[c].cast(dict(docs.dtypes)[c]) for c in docs.columns]))
    for name, stage in corpus_pipeline.STAGES:
        at = materialise(stage(spark, at, SF), f"test-{name}")
        left = sorted((r["doc_id"] or 0) for r in at.select("doc_id").collect() if r["doc_id"] is None or r["doc_id"] >= 20_000)
        without = [] if name != "toxicity" else [0]
        assert left == [*without, 20_001, 20_002, 20_003, 20_003, 20_004, 20_004, 20_005, 20_006], name
    final = {r["doc_id"]: r for r in at.collect() if r["doc_id"] >= 20_000}
    assert list(final[20_001]["ids"]) == [] == list(final[20_002]["ids"]) and "secret" in final[20_006]["decoded"] and "hunter" not in final[20_006]["decoded"]


def test_encoding_leaves_little_in_the_workers(spark):
    """Python processes outlive the stage; what its encoder keeps there is bounded, and long runs aren't kept."""
    rows = [(d, " ".join(f"{d}x{k}" for k in range(1000)) + " " + "long" * 100 + f" {d}") for d in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    t = bpe.tokenizer(queries.vocabulary())
    for d, x in rows[::40]:
        assert list(got[d]["ids"]) == t.encode(x, add_special_tokens=False).ids and got[d]["n_tokens"] == len(got[d]["ids"])

    def left(batches):
        from splicelake.llm import bpe

        own = [x for x in bpe._loaded.values() if isinstance(x, bpe.Encoder) and getattr(x, "keep", corpus_pipeline.KEEP) == corpus_pipeline.KEEP]
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([max((len(x.cache) for x in own), default=0)]), pa.array([max((len(r) for x in own for r in x.cache), default=0)])], names=["runs", "longest"])

    runs, longest = zip(*((r["runs"], r["longest"]) for r in spark.range(16).repartition(16).mapInArrow(left, "runs long, longest long").collect()), strict=True)
    assert 0 < max(runs) <= corpus_pipeline.KEEP and max(longest) <= bpe.KEPT_LENGTH
