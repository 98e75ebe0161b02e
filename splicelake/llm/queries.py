"""The contract queries: thin digests over the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, divergence, language_id, lexical_search, near_dedup, ngram_lm, pii, quality, quality_trees, repeats, secrets, toxicity
from .common import fold, table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, percent=80)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(fold("doc_id", 4) != 2).select("text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score"
    )


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = ngram_lm.score(docs, docs.filter(fold("doc_id", 10) != 0))
    return scored.withColumn("held_out", fold("doc_id", 10) == 0)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2).select("doc_id", "toxic")
    return toxicity.score(docs, labels).withColumn("held_out", fold("doc_id", 4) == 2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), digests=True)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontam.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "longest_repeat"
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "marginal"
    )


def op11_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0).select("doc_id", "quality")
    return quality_trees.score(docs, labels).withColumn("held_out", fold("doc_id", 5) == 0)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_minhash_near_dedup, op2_language_id, op3_pii, op4_ngram_lm, op5_toxicity,
        op6_quality, op7_bpe, op8_decontamination, op9_suffix_dedup, op10_secrets,
        op11_quality_trees, op12_lexical_search, op13_source_divergence,
    )
    return {f.__name__: f for f in ops}


#: Words as op8 takes them, of any table's text column.
_WORDS8 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP8_SQL = rf"""
with d as (select doc_id, {_WORDS8} as w from documents),
b as (select item_id, {_WORDS8} as w from benchmark),
g as (select distinct item_id, least(13, len(w)) as n, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') as t
      from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from b where len(w) > 0)),
lens as (select distinct n from g),
p as (select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') as t
      from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
h as (select doc_id, p.i, p.n, item_id from p join g on p.t = g.t and p.n = g.n),
hit as (select doc_id, count(distinct k) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as k from h) group by doc_id),
it as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from h group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join it using (doc_id)
"""

_WORDS1 = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Links by counting shared shingles; only shingles of pairs of documents whose sizes allow a link.
OP1_SQL = rf"""
with recursive d as (select doc_id, {_WORDS1} as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) when len(w) = 1 then [w[1]] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as m from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * m >= 80 * (x.n + y.n - m)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from documents union select e.b, r.root from r join e on e.a = r.doc_id),
k as (select doc_id, min(root) as component_id from r group by doc_id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n using (doc_id) join k using (doc_id)
"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS12 = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_TERMS13 = rf"regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

#: Every document is scored for every item.
OP12_SQL = rf"""
with d as (select row_number() over () as k, doc_id, {_TERMS12} as w from documents),
s as (select count(*) as nd, sum(len(w)) as nl from d where len(w) > 0),
tf as (select k, t, count(*) as tf from (select k, unnest(w) as t from d) group by 1, 2),
df as (select t, cast(floor(1000 * ln((2 * (select nd from s) + 2) / (2 * count(*) + 1))) as hugeint) as w from tf group by 1),
m as (select k, doc_id, 50 + (50 * cast(len(w) as hugeint) * (select nd from s)) // (select nl from s) as m from d where len(w) > 0),
i as (select distinct item_id, unnest({_TERMS12}) as t from benchmark),
sc as (select item_id, k, doc_id, sum(w * ((1000000000 * cast(tf as hugeint)) // (1000 * tf + 20 * m))) as score from i join df using (t) join tf using (t) join m using (k) group by 1, 2, 3),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id nulls first, k) as rank from sc where score > 0)
select item_id, cast(rank as integer) as rank, doc_id, cast(score as bigint) as score from r where rank <= 50
"""

OP13_SQL = rf"""
with d as (select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source, {_TERMS13} as w from documents),
x as (select k, lang, source, unnest(w) as term from d),
v as (select lang, term, count(*) as n from x group by 1, 2 having count(distinct k) >= 3),
c as (select lang, source, term, count(*) as n from x join v using (lang, term) group by 1, 2, 3),
g as (select distinct lang, source from d),
ls as (select lang, count(*) as vv, sum(n) as nn from v group by 1),
gs as (select lang, source, sum(n) as nn from c group by 1, 2),
p as (select v.lang, g.source, v.term, coalesce(c.n, 0) as n, cast(1 + (1000000000 * cast(coalesce(c.n, 0) + 1 as hugeint)) // (coalesce(gs.nn, 0) + vv) as hugeint) as p,
  cast(1 + (1000000000 * cast(v.n + 1 as hugeint)) // (ls.nn + vv) as hugeint) as q
  from v join g using (lang) join ls using (lang) left join gs on gs.lang = g.lang and gs.source = g.source left join c on c.lang = v.lang and c.source = g.source and c.term = v.term),
pair as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
allp as (select a.lang, a.source, b.source as item, cast(coalesce(value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
t as (select lang, source, term as item, cast((p - q) * (p - q) // q as bigint) as value from p where n > 0 and p > q),
u as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from allp
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item) as rank from t)
select lang, source, part, item, value, cast(rank as integer) as rank from u where part = 'pair' or rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op8_decontamination": OP8_SQL, "op12_lexical_search": OP12_SQL, "op13_source_divergence": OP13_SQL}
