"""All that a drawing of genes needs, as tables: one gene by its name, chosen genes, or all genes at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ascii_lower
from ..operators import layout
from ..sources.stored import stored

#: Up to so many genes (or genes under which their events lie) go to the scans as literals.
LITERALS = 1000


def find_gene(genes: DataFrame, name: str) -> DataFrame:
    """The gene of that symbol (without the case of A-Z, the first by id), its `gene_symbol` as asked for; an error if there is none."""
    found = gene_id(genes, name)
    return genes.filter(F.col("gene_ensembl_id") == found).withColumn("gene_symbol", F.lit(name))


def gene_id(genes: DataFrame, name: str) -> str:
    found = genes.filter(ascii_lower(F.col("gene_symbol")) == ascii_lower(F.lit(name))).agg(F.min("gene_ensembl_id")).first()[0]
    if found is None:
        raise ValueError(f"gene {name!r} isn't in the table of genes")
    return found


def few(keys: DataFrame, most: int = LITERALS) -> list | None:
    """The distinct values of a column, unless there are over `most`."""
    rows = keys.distinct().limit(most + 1).collect()
    return [r[0] for r in rows] if len(rows) <= most else None


class GeneLayout(Mapping):
    """Tables by name: pages, transcripts, exon_parts, exon_colors, backbone, shapes, strips, labels, and of an overlay
    also drawings, junction_table and brackets. A table is made when it is asked for, from steps that are written once.

    The chosen genes come first: their keys go to the scans as literals if they are few (`annotation.write_clustered`
    makes tables that are pruned by them), else as semi-joins, so that windows, joins and axes see their rows alone.
    """

    TABLES = ("pages", "transcripts", "exon_parts", "exon_colors", "backbone", "shapes", "strips", "labels")
    OVERLAY = ("drawings", "junction_table", "brackets")

    def __init__(
        self, tables: Mapping[str, DataFrame], genes: DataFrame | None, protein_only: bool, domains_only: bool, report: DataFrame | None, drawings: DataFrame | None, clusters: DataFrame | None, per_page: int
    ) -> None:
        self.tables, self.chosen, self.protein_only, self.domains_only = tables, genes, protein_only, domains_only
        self.report, self.drawings, self.clusters, self.per_page = report, drawings, clusters, per_page

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.names:
            raise KeyError(name)
        return getattr(self, f"_{name}")()

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)

    @property
    def names(self) -> tuple[str, ...]:
        return self.TABLES + (self.OVERLAY if self.report is not None else ())

    # Steps, each written once.

    def _wide(self, df: DataFrame) -> DataFrame:
        """Of all genes, a table that isn't to be sent to the driver for a join: Parquet of ids and places takes a tenth to a
        fortieth of what its rows do in memory, so that the size of the files tells nothing."""
        return df if self.chosen is not None else df.hint("merge")

    def _step(self, df: DataFrame, name: str) -> DataFrame:
        return self._wide(stored(df, f"layout-{name}"))

    @property
    def genes(self) -> DataFrame:
        return self._wide(self.tables["genes"]) if self.chosen is None else self.chosen

    @cached_property
    def gene_ids(self) -> list | None:
        return None if self.chosen is None else few(self.chosen.select("gene_ensembl_id"))

    def _of_genes(self, name: str) -> DataFrame:
        """A table by its own column of genes."""
        if self.gene_ids is not None:
            return self.tables[name].filter(F.col("gene_ensembl_id").isin(self.gene_ids))
        return self.tables[name].join(self.genes.select("gene_ensembl_id").distinct(), "gene_ensembl_id", "left_semi")

    def _of_transcripts(self, name: str) -> DataFrame:
        """A table of the chosen genes' transcripts: by its genes too, where it has them and they are few."""
        pruned = self._of_genes(name) if self.gene_ids is not None and "gene_ensembl_id" in self.tables[name].columns else self.tables[name]
        return pruned.drop("gene_ensembl_id").join(self.transcripts.select("transcript_ensembl_id").distinct(), "transcript_ensembl_id", "left_semi")

    @cached_property
    def transcripts(self) -> DataFrame:
        return self._step(self._of_genes("transcripts"), "transcripts")

    @cached_property
    def exons(self) -> DataFrame:
        if self.chosen is None:  # what reads them joins them with transcripts
            return self.tables["transcript_exon"].drop("gene_ensembl_id")
        return self._step(self._of_transcripts("transcript_exon"), "exons")

    @cached_property
    def proteins(self) -> DataFrame:
        return self._step(self._of_transcripts("proteins"), "proteins")

    @cached_property
    def domains(self) -> DataFrame:
        """The domains of the first protein of each transcript, as of `protein_sites`, with tx."""
        first, events = layout.first_protein(self.proteins), self.tables["domain_event"]
        if self.gene_ids is not None and "home" in events.columns:  # the gene under which a protein's events lie
            homes = few(self.proteins.select("home"))
            events = events if homes is None else events.filter(F.col("home").isin(homes))
        own = events.join(first.select(F.col("protein").alias("protein_ensembl_id")).distinct(), "protein_ensembl_id", "left_semi")
        return self._step(layout.protein_sites(own, self.tables["domain_type"].select("type_id")).join(first, "protein"), "domains")

    @cached_property
    def exon_colors(self) -> DataFrame:
        """By all transcripts of a gene, before any is left out."""
        return self._step(layout.exon_colors(self.exons, self.transcripts), "colors")

    @cached_property
    def drawn(self) -> DataFrame:
        if self.chosen is None:  # of all genes, which proteins have a domain is asked before the domains are made
            known = self.tables["domain_event"].join(self.tables["domain_type"].select("type_id").distinct(), "type_id", "left_semi")
            proteins = known.select(F.col("protein_ensembl_id").alias("protein")).filter("protein is not null")
            flags = layout.transcript_flags(self.transcripts, self.exons, self._wide(self.tables["proteins"]), proteins)
            return self._step(layout.drawn_transcripts(self.transcripts, flags, self.protein_only, self.domains_only), "drawn")
        with ThreadPoolExecutor(2) as pool:  # neither needs the other
            self.transcripts  # noqa: B018  both need it: written first
            for step in [pool.submit(getattr, self, name) for name in ("exons", "domains")]:
                step.result()
        flags = layout.transcript_flags(self.transcripts, self.exons, self.proteins, self.domains)
        return self._step(layout.drawn_transcripts(self.transcripts, flags, self.protein_only, self.domains_only), "drawn")

    @cached_property
    def segments(self) -> DataFrame:
        return self._step(layout.coding_segments(self._drawn_exons), "segments")

    @cached_property
    def axis(self) -> DataFrame:
        """tx, gene_ensembl_id, axis_max."""
        return self._step(self._of.join(layout.gene_axis(self.drawn, self.segments, self._own), "gene_ensembl_id").select("tx", "gene_ensembl_id", "axis_max"), "axis")

    @cached_property
    def hits(self) -> DataFrame:
        return self._step(layout.domain_segments(self._own, self.segments), "hits")

    @property
    def paged(self) -> DataFrame:
        return layout.pages(self.drawn, self.per_page)

    @property
    def extents(self) -> DataFrame:
        return layout.gene_extents(self.drawn)

    @property
    def segment_colors(self) -> DataFrame:
        return layout.segment_colors(self.segments, self.drawn, self.exon_colors)

    @property
    def _of(self) -> DataFrame:
        return self.drawn.select(F.col("transcript_ensembl_id").alias("tx"), "gene_ensembl_id")

    @property
    def _drawn_exons(self) -> DataFrame:
        return self.exons.join(self.drawn.select("transcript_ensembl_id"), "transcript_ensembl_id", "left_semi")

    @property
    def _own(self) -> DataFrame:
        known = self.domains.filter("AA_start is not null and AA_end is not null")
        return known.join(self._of.select("tx"), "tx", "left_semi")

    # Tables.

    def _pages(self) -> DataFrame:
        return layout.page_titles(layout.titles(self.genes, self.extents), self.paged, self.clusters)

    @property
    def titled(self) -> DataFrame:
        """gene_ensembl_id, title, n_pages: `pages` without the pages."""
        return layout.with_clusters(layout.titles(self.genes, self.extents), self.clusters).join(layout.page_counts(self.paged), "gene_ensembl_id")

    @property
    def captioned(self) -> DataFrame:
        """gene_ensembl_id, tx, page, slot, caption: `transcripts` without the axis."""
        return self.paged.join(layout.transcript_captions(self.drawn), "tx")

    def _transcripts(self) -> DataFrame:
        return self.captioned.join(self.axis.select("tx", "axis_max"), "tx")

    def _exon_parts(self) -> DataFrame:
        return layout.exon_parts(self._drawn_exons, self.drawn)

    def _exon_colors(self) -> DataFrame:
        return self.exon_colors

    def _backbone(self) -> DataFrame:
        return layout.backbone_segments(self.segments, self.drawn, self.axis.select("gene_ensembl_id", "axis_max").distinct())

    def _shapes(self) -> DataFrame:
        return layout.domain_shapes(self._own.select("tx", "AA_start", "AA_end", "position"), self.hits, self.segment_colors, self.axis.select("tx", "axis_max"))

    def _strips(self) -> DataFrame:
        return layout.domain_strips(self.hits, self.axis.select("tx", "axis_max"))

    def _labels(self) -> DataFrame:
        own = self._own.drop("protein").withColumnRenamed("tx", "key")
        return layout.label_lanes(layout.island_labels(own, self.axis.select(F.col("tx").alias("key"), "axis_max"), self._wide(self.tables["domain_type"])))

    def _drawings(self) -> DataFrame:
        return self.drawings

    def _junction_table(self) -> DataFrame:
        return layout.junction_table(self.report)

    def _brackets(self) -> DataFrame:
        """All junctions of a cluster meet the transcripts of its drawn gene, whatever gene they name themselves."""
        at = self._drawn_exons.join(self._of.withColumnRenamed("tx", "transcript_ensembl_id"), "transcript_ensembl_id")
        at = at.select(F.col("gene_ensembl_id").alias("gene"), F.col("transcript_ensembl_id").alias("tx"), F.col("genomic_start_tx").alias("gs"), F.col("genomic_end_tx").alias("ge"))
        numbers = layout.junction_numbers(self.report.select("ord", "cluster", "start", "end"))
        junctions = numbers.join(self.drawings.select("cluster", F.col("gene_ensembl_id").alias("gene")), "cluster")
        return layout.junction_brackets(layout.matching_junctions(junctions, at))


def gene_layout(
    tables: Mapping[str, DataFrame], gene: str | None = None, protein_only: bool = False, domains_only: bool = False, clusters: DataFrame | None = None, per_page: int = 4
) -> GeneLayout:
    """The layout of the gene of that symbol, or of all genes. Filters come before pages, extents and axes; a gene with
    no transcript left has no rows. `clusters`: gene_ensembl_id, cluster_name, for the titles."""
    genes = None if gene is None else find_gene(tables["genes"], gene)
    return GeneLayout(tables, genes, protein_only, domains_only, None, None, clusters, per_page)


def drawn_genes(report: DataFrame, genes: DataFrame) -> DataFrame:
    """cluster, gene_ensembl_id: what is drawn of each cluster of `report` (rows of whole clusters).

    That is the gene found by the symbol of the first junction's gene: of several genes of one symbol the first by id.
    A cluster whose gene has no row, or no symbol, has no drawing.
    """
    first = report.groupBy("cluster").agg(F.min_by("gene_id", "ord").alias("g")).select("cluster", F.split_part("g", F.lit(":"), F.lit(1)).alias("gene_ensembl_id"))
    symbol = genes.groupBy("gene_ensembl_id").agg(F.min("gene_symbol").alias("symbol"))
    named = first.join(symbol, "gene_ensembl_id").select("cluster", "symbol")
    return named.join(layout.gene_by_symbol(genes, named.select("symbol")), "symbol").select("cluster", "gene_ensembl_id")


def overlay(tables: Mapping[str, DataFrame], report: DataFrame, per_page: int = 4) -> GeneLayout:
    """The drawn genes of `report`'s clusters alone (transcripts with a protein and domains), with the junction table and
    brackets of each cluster, and drawings (cluster, gene_ensembl_id). A cluster without a drawing is in none of them."""
    drawings = stored(drawn_genes(report, tables["genes"]), "overlay-drawings")
    genes = stored(tables["genes"].join(drawings.select("gene_ensembl_id").distinct(), "gene_ensembl_id", "left_semi"), "overlay-genes")
    shown = stored(report.join(drawings.select("cluster"), "cluster", "left_semi"), "overlay-report")
    return GeneLayout(tables, genes, True, True, shown, drawings, None, per_page)
