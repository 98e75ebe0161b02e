"""Annotation tables as Parquet clustered by gene, of which a scan for a few genes reads a few row groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: By what each table is clustered: `home` is one gene (the first by id) under which all events of a protein lie.
CLUSTERED = {"transcripts": "gene_ensembl_id", "transcript_exon": "gene_ensembl_id", "proteins": "gene_ensembl_id", "domain_event": "home"}
ROW_GROUP = 1 << 20


def with_genes(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the columns that they are clustered by. A transcript in several genes counts for the first by id,
    as does a protein's home; exons, proteins and events of no known gene are kept, with a null one."""
    gene = tables["transcripts"].groupBy("transcript_ensembl_id").agg(F.min("gene_ensembl_id").alias("gene_ensembl_id"))
    proteins = tables["proteins"].join(gene, "transcript_ensembl_id", "left")
    home = proteins.groupBy("protein_ensembl_id").agg(F.min("gene_ensembl_id").alias("home"))
    return {**tables} | {
        "transcript_exon": tables["transcript_exon"].join(gene, "transcript_ensembl_id", "left"),
        "proteins": proteins.join(home, "protein_ensembl_id", "left"),
        "domain_event": tables["domain_event"].join(home, "protein_ensembl_id", "left"),
    }


def write_clustered(tables: Mapping[str, DataFrame], folder: str, row_group: int = ROW_GROUP) -> None:
    """The tables, each under its name; those of `CLUSTERED` in ranges of genes, sorted, in row groups of about
    `row_group` bytes, with Bloom filters on the gene. Existing tables are replaced."""
    for name, df in with_genes(tables).items():
        writer = df.write
        if (key := CLUSTERED.get(name)) is not None:
            writer = df.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.block.size", row_group).option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.mode("overwrite").parquet(f"{folder}/{name}")


def read_clustered(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names or ["genes", "domain_type", *CLUSTERED]}
