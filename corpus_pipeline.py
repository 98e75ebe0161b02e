"""A corpus pipeline of five stages over `documents`: toxic documents go, one document of each near-duplicate
group stays, contaminated documents go, secrets are masked, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from splicelake.llm import bpe, decontam, near_dedup, secrets, toxicity
from splicelake.llm.common import fold, materialise, table
from splicelake.llm.queries import vocabulary

#: Runs that a Python process keeps from the encoding stage: the next run's stages share their memory with it.
KEEP = 50_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, learnt from the labels outside the held-out fold. Null and empty texts have the score
    of texts without any of the terms; of rows of one id, if one is toxic all go; a row without an id stays."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2).select("doc_id", "toxic")
    return toxicity.remove_toxic(docs, labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.8 on words by five make, the document of the smallest id stays, in all its rows.
    Null, empty and wordless texts are linked with nothing and stay; rows without an id go."""
    return near_dedup.remove_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more is hit by benchmark windows go, with all rows of their id. Null
    and wordless texts have no hit and stay."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays, its secrets replaced by a mark and n_chars counted anew; null texts stay null."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded, a row for each row; a null text is empty: no ids, and an empty text decoded."""
    return bpe.encode(docs, vocabulary(), keep=KEEP)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

#: The toxicity and encoding stages can't be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
