"""The whole pipeline: junctions and annotation in, one report row a junction out."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalars import without_version
from ..operators import core
from ..sources.files import read_database, read_junction_sheet, write_report
from ..sources.stored import stored
from ..sources.tables import checked
from .gene_layout import GeneLayout, overlay


def _items(lists: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(lists).isNotNull(), F.size(lists))), F.lit(0))


class Stages:
    """The steps of a run, made when asked for. Those that several later steps read (`domains` or `sites`,
    `usable`, `held`, `compared` or `report`) are written once to the shared folder; the others are lazy.

    `counts` has the rows of each step that a written one has come by so far, for a run's progress: they are observed
    while it is written, so that nothing is scanned for them."""

    def __init__(self, tables: Mapping[str, DataFrame], normalize_gene_id: bool, null_name_literal: str | None, on_error: str) -> None:
        self.tables, self.normalize_gene_id, self.null_name_literal, self.on_error = tables, normalize_gene_id, null_name_literal, on_error
        self.counts: dict[str, int] = {}
        self._seen: dict[str, Observation] = {}

    def _observed(self, df: DataFrame, name: str, count: Column | None = None) -> DataFrame:
        self._seen[name] = Observation(name)
        return df.observe(self._seen[name], (F.count(F.lit(1)) if count is None else count).alias("rows"))

    def _stored(self, df: DataFrame, name: str, *through: str, count: Column | None = None) -> DataFrame:
        out = stored(self._observed(df, name, count), name)
        self._counted(*through, name)
        return out

    def _counted(self, *names: str) -> None:
        for n in names:
            try:
                self.counts[n] = self._seen[n].get["rows"]
            except Py4JJavaError:  # a plan known to be empty is cut short, and observes nothing
                self.counts[n] = 0

    @cached_property
    def junctions(self) -> DataFrame:
        return self._observed(core.parse_junctions(self.tables["junctions"], self.on_error), "junctions")

    @cached_property
    def domains(self) -> DataFrame:
        t = self.tables
        return self._stored(core.transcript_domains(t["transcripts"], t["proteins"], t["domain_event"], t["domain_type"]), "domains")

    @cached_property
    def sites(self) -> DataFrame:
        """The domains without their names: all that most steps ask of them."""
        t = self.tables
        return stored(core.transcript_sites(t["transcripts"], t["proteins"], t["domain_event"], t["domain_type"].select("type_id")), "sites")

    @property
    def _placed(self) -> DataFrame:
        """gene, tx of the domains: of those with names if they are made already."""
        return self.domains if "domains" in self.__dict__ else self.sites

    @cached_property
    def exons(self) -> DataFrame:
        """Dealt by transcript, as the join with junctions collects them."""
        return self._observed(core.exon_ranges(self.tables["transcript_exon"], self._placed), "exons")

    @cached_property
    def usable(self) -> DataFrame:
        return self._stored(core.usable_by_name(self.junctions, self._placed), "usable", "junctions")

    @property
    def _gene(self) -> tuple[str, ...]:
        return ("gene" if self.normalize_gene_id else "gene_raw",)

    @cached_property
    def ranges(self) -> DataFrame:
        """With the gene under which a junction's domains are looked up."""
        return self._observed(core.nonskipping_aa_ranges(self.usable, self.exons, more=self._gene), "ranges")

    @cached_property
    def relevant(self) -> DataFrame:
        types = self.tables["domain_type"]
        ranges = core.nonskipping_aa_ranges(self.usable, self.exons, more=self._gene, of=core.sites_by_transcript(self.sites, types))
        return core.relevant_sites(ranges, types, self.normalize_gene_id)

    @cached_property
    def held(self) -> DataFrame:
        """Its rows are counted as `kept`, by their domains. The domains are made for it alone, unless they are there, and
        what it holds junctions against isn't written: it comes dealt by gene, as the join takes it."""
        t, made = self.tables, "domains" in self.__dict__
        most = t["transcripts"].groupBy("gene_ensembl_id").count().agg(F.max("count")).first()[0] or 0
        per = t["junctions"].groupBy(without_version(F.col("ensembl_h")).alias("gene")).count().filter((F.col("count") > core.HOT) & F.col("gene").isNotNull())
        hot = {r["gene"]: -(-r["count"] // core.HOT) for r in per.collect()}  # a row a million junctions at most
        domains = self.domains if made else self._observed(core.transcript_domains(t["transcripts"], t["proteins"], t["domain_event"], t["domain_type"]), "domains")
        n_exons = F.aggregate("transcripts", F.lit(0), lambda n, x: n + F.coalesce(F.array_size(x["exons"]), F.lit(0)))
        annotation = self._observed(core.gene_annotation(domains, t["transcript_exon"], self.null_name_literal), "exons", F.coalesce(F.sum(n_exons), F.lit(0)))
        rows = self._observed(core.annotated_junctions(self.junctions, annotation, self.normalize_gene_id, most > core.GENE_PART, hot), "usable")
        rows = self._observed(rows, "ranges", F.coalesce(F.sum("n_ranges"), F.lit(0))).drop("n_ranges", "start", "end")
        return self._stored(rows, "kept", "junctions", "exons", "usable", "ranges", *([] if made else ["domains"]), count=_items("own"))

    @property
    def kept(self) -> DataFrame:
        return self.held.select("ord", F.inline("own"))

    @property
    def _compared(self) -> DataFrame:
        return core.with_places(core.compared(self.held, core.gene_names(self.held, self.tables["genes"])))

    @cached_property
    def compared(self) -> DataFrame:
        """Its rows are counted as `found`, by their verdicts."""
        return self._stored(self._compared, "found", count=_items("lines"))

    @property
    def found(self) -> DataFrame:
        return core.verdicts(self.compared)

    @cached_property
    def report(self) -> DataFrame:
        """Written as its texts; where `compared` is there already, made of it."""
        if "compared" in self.__dict__:
            return core.report(self.compared)
        out = stored(core.report(self._observed(self._compared, "found", _items("lines"))), "report")
        self._counted("found")
        return out

    @cached_property
    def progress(self) -> DataFrame:
        """ord, cluster, n_transcripts: how many transcripts of each usable junction don't skip it."""
        per = self.ranges.groupBy("ord").agg(F.count("*").alias("n"))
        return self.usable.select("ord", "cluster").join(per, "ord", "left").select("ord", "cluster", F.coalesce("n", F.lit(0)).alias("n_transcripts"))


def stages(tables: Mapping[str, DataFrame], normalize_gene_id: bool = False, null_name_literal: str | None = None, on_error: str = "fail") -> Stages:
    return Stages(tables, normalize_gene_id, null_name_literal, on_error)


def cluster_report(tables: Mapping[str, DataFrame], **options) -> DataFrame:
    return stages(tables, **options).report


def report_of_files(spark, sheet: str, database: str, output_csv: str, gene_ids: str | None = None, **options) -> GeneLayout | None:
    """A workbook of junctions and an SQLite database in, the report as one CSV file out. With `gene_ids`
    (comma-separated) the overlay of their clusters comes back, after the report is written; else None."""
    tables = read_database(spark, database) | {"junctions": read_junction_sheet(spark, sheet)}
    tables = {n: checked(df, n) for n, df in tables.items()}
    run = stages(tables, **options)
    report = run.report
    write_report(report, output_csv)
    for name, n in run.counts.items():
        print(f"{name}: {n:,} rows")
    return None if gene_ids is None else overlay(tables, requested(report, gene_ids))


def requested(report: DataFrame, gene_ids: str) -> DataFrame:
    """Report rows of the clusters whose first junction's gene is in a comma-separated list."""
    chosen = report.groupBy("cluster").agg(F.min_by("gene_id", "ord").alias("g")).filter(_asked("g", gene_ids)).select("cluster")
    return report.join(chosen, "cluster", "left_semi")


def _asked(gene: str, gene_ids: str) -> Column:
    return F.split_part(gene, F.lit(":"), F.lit(1)).isin([g.strip() for g in gene_ids.split(",")])


def requested_report(tables: Mapping[str, DataFrame], gene_ids: str, on_error: str = "fail", **options) -> DataFrame:
    """`requested` of the whole report, written, of which only the clusters that name one of the genes are made.

    All rows of such a cluster come along, and of the annotation what its genes have: a cluster's rows of the report
    depend on nothing else. Small tables are written first, so that the scans of large ones are filtered before any
    shuffle.
    """
    named = core.parse_junctions(tables["junctions"], on_error).filter(_asked("gene_raw", gene_ids)).select("cluster").distinct()
    rows = stored(tables["junctions"].join(stored(named, "requested-clusters"), "cluster", "left_semi"), "requested-junctions")
    ids = F.array("gene", "gene_raw", F.split_part("gene_raw", F.lit(":"), F.lit(1)))
    genes = stored(core.parse_junctions(rows, on_error).select(F.explode(ids).alias("gene_ensembl_id")).distinct(), "requested-genes")
    transcripts = stored(tables["transcripts"].join(genes, "gene_ensembl_id", "left_semi"), "requested-transcripts")
    of = lambda name, key: stored(tables[name].join(transcripts.select(key).distinct(), key, "left_semi"), f"requested-{name}")
    some = {
        "junctions": rows, "transcripts": transcripts, "genes": stored(tables["genes"].join(genes, "gene_ensembl_id", "left_semi"), "requested-annotated"),
        "proteins": of("proteins", "transcript_ensembl_id"), "transcript_exon": of("transcript_exon", "transcript_ensembl_id"),
        "domain_event": of("domain_event", "protein_ensembl_id"), "domain_type": tables["domain_type"],
    }
    return stored(requested(stages(some, on_error=on_error, **options).report, gene_ids), "requested")
