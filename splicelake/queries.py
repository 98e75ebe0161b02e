"""Queries over the stand-in tables, and the same in SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .operators import core, layout
from .plans.gene_layout import gene_layout, overlay
from .plans.page_documents import page_documents
from .plans.report import requested_report, stages
from .sources.files import write_report
from .sources.stored import shared_folder
from .sources.tables import VIEWS, stand_ins

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_V = lambda c: rf"({c} is not null and regexp_replace({c}, '^\s+|\s+$', '', 'g') not in ('', 'nan'))"
_P = lambda c: rf"({c} is not null and regexp_replace({c}, '^\s+|\s+$', '', 'g') <> '')"

#: Steps of the pipeline as common table expressions, each on those before it.
STEPS = {
    "j": """select ord, cluster, ensembl_h as gene_raw, split_part(ensembl_h, '.', 1) as gene, h_junction as junction_name, split_part(h_junction, ':', 1) as chromosome,
 cast(split_part(h_junction, ':', 2) as bigint) as "start", cast(split_part(h_junction, ':', 3) as bigint) as "end" from junctions
 where cluster is not null and ensembl_h is not null and cast(split_part(h_junction, ':', 2) as bigint) >= 0 and cast(split_part(h_junction, ':', 3) as bigint) >= 0""",
    "d": f"""select t.gene_ensembl_id as gene, t.transcript_ensembl_id as tx, p.protein_ensembl_id as protein, cast(e.AA_start as bigint) as AA_start, cast(e.AA_end as bigint) as AA_end,
 k.cdd, k.pfam, k.smart, k.tigr, k.interpro, k.CDD_id, k.description as short_description
 from proteins p join transcripts t on t.protein_ensembl_id = p.protein_ensembl_id and t.transcript_ensembl_id = p.transcript_ensembl_id
 join domain_event e on e.protein_ensembl_id = p.protein_ensembl_id join domain_type k on k.type_id = e.type_id
 where {_P("p.protein_ensembl_id")} and {_P("e.protein_ensembl_id")} and e.AA_start is not null and e.AA_end is not null""",
    "x": """select g.gene, g.tx, exon_rank, genomic_start_tx as gs, genomic_end_tx as ge, coalesce(abs_start_CDS, 0) as cds_start,
 cast(coalesce(abs_start_CDS, 0) // 3 as bigint) as aa_start, cast(coalesce(abs_end_CDS, 0) // 3 as bigint) as aa_end from transcript_exon e join (select distinct gene, tx from d) g on g.tx = e.transcript_ensembl_id""",
    "u": "select * from j where gene in (select gene from d)",
    "sk": 'select distinct u.ord, x.tx from u join x on u.gene = x.gene and abs(x.gs - u."end") <= 1 and abs(x.ge - u."start") <= 1',
    "r": """select u.ord, x.tx, min(aa_start) as aa_start, max(aa_end) as aa_end from u join x on u.gene = x.gene and x.gs <= u."end" and x.ge >= u."start"
 where cds_start > 0 and not exists (select 1 from sk where sk.ord = u.ord and sk.tx = x.tx) group by u.ord, x.tx""",
    "rd": """select r.ord, d.AA_start, d.AA_end, cdd, pfam, smart, tigr, interpro, CDD_id, short_description, min(d.tx) as tx
 from r join u on u.ord = r.ord join d on d.tx = r.tx and d.gene = u.gene_raw and d.AA_start <= r.aa_end and d.AA_end >= r.aa_start group by all""",
    "k": f"""select ord, name, AA_end - AA_start + 1 as len, AA_start, AA_end, short_description as description from
 (select *, row_number() over (partition by ord, name order by AA_end - AA_start desc, tx, AA_start, AA_end, short_description) as n from
 (select *, coalesce({", ".join(f"case when {_V(c)} then {c} end" for c in scalars.NAME_COLUMNS)}) as name from rd) where name is not null) where n = 1""",
    "f": """select cluster, ord, category, name, message, replace(coalesce(description, ''), ';', ' | ') as description from (
 select cluster, ord, 0 as category, name, 'only has ' || name || ', ' || len as message, description from a where other is null and len is not null
 union all select cluster, ord, 1, name, 'Missing ' || name || ', ' || other, other_description from a where len is null and other is not null
 union all select cluster, ord, 2, name, case when len > other then 'Longer ' else 'Shorter ' end || name || ', ' || len || ' vs ' || other, description from a where len <> other)""",
}
#: Each junction and name of its cluster, with the best of the other junctions by a self-join.
_A = """select s.cluster, s.ord, s.name, o.len, o.description, -z.b.l as other, z.b.d as other_description from
 (select u.cluster, u.ord, n.name from u join (select distinct u.cluster, k.name from u join k on k.ord = u.ord) n on n.cluster = u.cluster
  join (select cluster from u group by cluster having count(*) > 1) c on c.cluster = u.cluster) s
 left join k o on o.ord = s.ord and o.name = s.name
 left join (select s.ord, s.name, min({'l': -w.len, 'o': w.ord, 'd': w.description}) as b from
   (select u.cluster, u.ord, n.name from u join (select distinct u.cluster, k.name from u join k on k.ord = u.ord) n on n.cluster = u.cluster) s
   join (select u.cluster, k.* from k join u on u.ord = k.ord) w on w.cluster = s.cluster and w.name = s.name and w.ord <> s.ord group by s.ord, s.name) z on z.ord = s.ord and z.name = s.name"""
_ORDER = ["j", "d", "x", "u", "sk", "r", "rd", "k", "a", "f"]


def _sql(body: str, upto: str = "", more: str = "") -> str:
    names = _ORDER[: _ORDER.index(upto) + 1] if upto else []
    ctes = [f"{n} as materialized ({q})" for n, q in VIEWS.items()] + [f"{n} as materialized ({STEPS.get(n, _A)})" for n in names] + ([more] if more else [])
    return "with " + ",\n".join(ctes) + "\n" + body


def _query(name: str, sql: str | None = None):
    def keep(f: Callable[[Mapping[str, DataFrame]], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(stand_ins(spark, sf_dir))
        if sql:
            _SQL[name] = sql
        return f

    return keep


@_query("junction_parse", _sql('select ord, cluster, gene_raw, gene, junction_name, chromosome, "start", "end" from j', "j"))
def _(t):
    return core.parse_junctions(t["junctions"])


@_query("gene_id_normalize", _sql("select distinct ensembl_h as gene_raw, split_part(ensembl_h, '.', 1) as gene from junctions where ensembl_h is not null"))
def _(t):
    return t["junctions"].filter("ensembl_h is not null").select(F.col("ensembl_h").alias("gene_raw"), scalars.without_version(F.col("ensembl_h")).alias("gene")).distinct()


@_query("gene_transcripts", _sql("select distinct transcript_ensembl_id from transcripts where gene_ensembl_id in (select gene from j)", "j"))
def _(t):
    return core.gene_transcripts(t["transcripts"], core.parse_junctions(t["junctions"]))


@_query("transcript_domains", _sql("select * from d", "d"))
def _(t):
    return stages(t).domains


@_query("domain_first_name", _sql(f"select type_id, coalesce({', '.join(f'case when {_V(c)} then {c} end' for c in scalars.NAME_COLUMNS)}) as name from domain_type"))
def _(t):
    return t["domain_type"].select("type_id", scalars.first_valid_name().alias("name"))


@_query("exon_aa_coords", _sql("select gene, tx, exon_rank, gs, ge, cds_start, aa_start, aa_end from x", "x"))
def _(t):
    return stages(t).exons


@_query("skipping_transcripts", _sql("select ord, tx from sk", "sk"))
def _(t):
    s = stages(t)
    return core.skipping_transcripts(s.usable, s.exons)


_SUP = (
    'select l.ord, l.tx from (select u.ord, x.tx, min(exon_rank) as a from u join x on u.gene = x.gene and abs(x.ge - u."start") <= 1 group by u.ord, x.tx) l '
    'join (select u.ord, x.tx, min(exon_rank) as b from u join x on u.gene = x.gene and abs(x.gs - u."end") <= 1 group by u.ord, x.tx) r on l.ord = r.ord and l.tx = r.tx where '
)


@_query("supporting_transcripts", _sql(_SUP + "abs(a - b) = 1", "u"))
def _(t):
    s = stages(t)
    return core.supporting_transcripts(s.usable, s.exons)


@_query("supporting_transcripts_strict", _sql(_SUP + "a - b = 1", "u"))
def _(t):
    s = stages(t)
    return core.supporting_transcripts(s.usable, s.exons, strict=True)


@_query("supporting_aa_ranges", _sql(f"select ord, p.tx, aa_start, aa_end from ({_SUP}abs(a - b) = 1) p join (select tx, min(aa_start) as aa_start, max(aa_end) as aa_end from x where cds_start > 0 group by tx) c on c.tx = p.tx", "u"))
def _(t):
    s = stages(t)
    return core.supporting_aa_ranges(s.usable, s.exons)


@_query("progress_counts", _sql("select u.ord, u.cluster, count(r.tx) as n_transcripts from u left join r on r.ord = u.ord group by u.ord, u.cluster", "r"))
def _(t):
    return stages(t).progress


@_query("nonskipping_aa_ranges", _sql("select ord, tx, aa_start, aa_end from r", "r"))
def _(t):
    return stages(t).ranges.select("ord", "tx", "aa_start", "aa_end")


@_query("relevant_domains", _sql("select * from rd", "rd"))
def _(t):
    return stages(t).relevant


@_query("longest_domain_per_name", _sql("select * from k", "k"))
def _(t):
    return stages(t).kept


@_query("domain_verdicts", _sql("select cluster, ord, category, name, message, description from f", "f"))
def _(t):
    return stages(t).found


_REPORT = """select u.ord, u.cluster, g.gene_name, u.junction_name, u.gene_raw as gene_id, u."start", u."end",
 case when n = 1 then 'Nothing to compare' else coalesce(results, '') end as comparison_results, case when n = 1 then 'no description' else coalesce(descriptions, '') end as domain_descriptions
 from u join (select cluster, count(*) as n from u group by cluster) c on c.cluster = u.cluster
 left join (select ord, string_agg(message, ';' order by category, name) as results, string_agg(description, ';' order by category, name) as descriptions from f group by ord) l on l.ord = u.ord
 join (select cluster, case when gg.gene_ensembl_id is not null then gg.gene_symbol else split_part(raw, ':', 1) end as gene_name from
  (select cluster, arg_min(gene_raw, ord) as raw from u group by cluster) q left join genes gg on gg.gene_ensembl_id = split_part(raw, ':', 1)) g on g.cluster = u.cluster"""


@_query("cluster_report", _sql(_REPORT, "f"))
def cluster_report(t):
    return stages(t).report


@_query("single_junction_clusters", _sql("select cluster, min(ord) as ord from u group by cluster having count(*) = 1", "u"))
def _(t):
    return stages(t).usable.groupBy("cluster").agg(F.min("ord").alias("ord"), F.count("*").alias("n")).filter("n = 1").drop("n")


_SOME = "('G7', 'G17', 'G27.2', 'G12', 'G13', 'G101')"


@_query("requested_genes_overlay", _sql(f"select * from ({_REPORT}) where cluster in (select cluster from u group by cluster having split_part(arg_min(gene_raw, ord), ':', 1) in {_SOME})", "f"))
def _(t):
    return requested_report(t, "G7, G17,G27.2 ,G12,G13,G101")


@_query("gene_symbol_lookup", _sql("select lower(gene_symbol) as symbol, arg_min(gene_ensembl_id, gene_ensembl_id) as gene_ensembl_id, arg_min(gene_symbol, gene_ensembl_id) as gene_symbol from genes group by 1"))
def _(t):
    return layout.gene_by_symbol(t["genes"], t["genes"].select(F.lower("gene_symbol").alias("symbol")))


_TO = "select gene_ensembl_id, transcript_ensembl_id as tx, row_number() over (partition by gene_ensembl_id order by tx_start, transcript_ensembl_id) as position from transcripts"


@_query("gene_transcripts_ordered", _sql(_TO))
def _(t):
    return layout.transcripts_ordered(t["transcripts"])


_XO = """select transcript_ensembl_id as tx, genomic_start_tx as gs, genomic_end_tx as ge, abs_start_CDS as cds_start, abs_end_CDS as cds_end,
 row_number() over (partition by transcript_ensembl_id order by case when z and abs_start_CDS = 0 then 0 else 1 end, case when z and abs_start_CDS = 0 then genomic_start_tx else abs_start_CDS end, genomic_start_tx, genomic_end_tx, exon_rank) as position
 from (select *, max(abs_start_CDS = 0) over (partition by transcript_ensembl_id) as z from transcript_exon) where not z or abs_start_CDS >= 0"""


@_query("exon_display_order", _sql(_XO))
def _(t):
    return layout.exon_order(t["transcript_exon"])


@_query("transcript_first_protein", _sql("select transcript_ensembl_id as tx, min(protein_ensembl_id) as protein from proteins where protein_ensembl_id is not null group by 1"))
def _(t):
    return layout.first_protein(t["proteins"])


_PD = """select e.protein_ensembl_id as protein, e.type_id, AA_start, AA_end, interpro, pfam, cdd, smart,
 row_number() over (partition by e.protein_ensembl_id order by AA_start nulls first, AA_end, e.type_id) as position from domain_event e join domain_type k on k.type_id = e.type_id"""
_PD_CTE = f"pd as ({_PD})"


@_query("protein_domains_ordered", _sql(_PD))
def _(t):
    return layout.protein_domains(t["domain_event"], t["domain_type"])


_EC = (
    f"select gene_ensembl_id, gs, ge, (row_number() over (partition by gene_ensembl_id order by p, q) - 1) % 48 as color from "
    f"(select gene_ensembl_id, gs, ge, min(o.position) as p, arg_min(x.position, o.position * 100000 + x.position) as q from ({_XO}) x join ({_TO}) o on o.tx = x.tx group by 1, 2, 3)"
)


@_query("exon_color_index", _sql(_EC))
def _(t):
    return layout.exon_colors(t["transcript_exon"], t["transcripts"])


_CS = """select tx, start_aa, end_aa, gs, ge, row_number() over (partition by tx order by start_aa, end_aa, gs, ge) as position from
 (select transcript_ensembl_id as tx, (abs_start_CDS - 1) / 3.0::double as start_aa, abs_end_CDS / 3.0::double as end_aa, genomic_start_tx as gs, genomic_end_tx as ge from transcript_exon where abs_start_CDS > 0 and abs_end_CDS >= abs_start_CDS)"""
_CS_CTE = f"cs as ({_CS})"
_r = lambda *cs: [F.round(c, 6).alias(c) for c in cs]


@_query("coding_segments", _sql("select tx, round(start_aa, 6) as start_aa, round(end_aa, 6) as end_aa, gs, ge, position from cs", more=_CS_CTE))
def _(t):
    return layout.coding_segments(t["transcript_exon"]).select("tx", *_r("start_aa", "end_aa"), "gs", "ge", "position")


def _lab(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


_LABELS = [_lab(c) for c in scalars.LABEL_COLUMNS]
_LABEL_SQL = f"""select protein, position, case when len(v) > 0 then substr(v[1], 1, 14) || case when many or len(v) > 1 or length(v[1]) > 14 then '*' else '' end end as label from
 (select protein, position, count(*) over (partition by protein) > 1 as many, list_filter([a, case when b is distinct from a then b end, case when c is distinct from a and c is distinct from b then c end,
   case when d is distinct from a and d is distinct from b and d is distinct from c then d end], lambda x: x is not null and x <> '' and lower(x) <> 'nan') as v
  from (select protein, position, {_LABELS[0]} as a, {_LABELS[1]} as b, {_LABELS[2]} as c, {_LABELS[3]} as d from pd))"""


@_query("domain_label", _sql(_LABEL_SQL, more=_PD_CTE))
def _(t):
    return layout.labels(layout.protein_domains(t["domain_event"], t["domain_type"]))


_ISL = """select protein, island, AA_start, AA_end, n > 1 as has_overlap, position from
 (select *, count(*) over (partition by protein, island) as n, row_number() over (partition by protein, island order by greatest(1, AA_end - AA_start + 1) desc, AA_start, position) as rn from
 (select *, cast(sum(fresh) over (partition by protein order by AA_start, position rows unbounded preceding) as bigint) as island from
 (select *, case when AA_start <= max(AA_end) over (partition by protein order by AA_start, position rows between unbounded preceding and 1 preceding) then 0 else 1 end as fresh from pd where AA_start is not null and AA_end is not null))) where rn = 1"""


@_query("domain_islands", _sql(_ISL, more=_PD_CTE))
def _(t):
    return layout.islands(layout.protein_domains(t["domain_event"], t["domain_type"]))


@_query("junction_display", _sql("select cluster, ord, row_number() over (partition by cluster order by ord) as idx, (row_number() over (partition by cluster order by ord) - 1) % 48 as color from j", "j"))
def _(t):
    return layout.junction_display(core.parse_junctions(t["junctions"]))


_MJ = """select ord, cluster, tx, l as "left", r as "right" from
 (select ord, cluster, tx, l, r, bool_or(ee = l) and bool_or(es = r) and not bool_or(es > l and ee < r) as boundary, bool_or(es < l and l < ee or es < r and r < ee) as inside from
 (select ord, cluster, gene, least("start", "end") as l, greatest("start", "end") as r from j) q join
 (select gene_ensembl_id as gene, e.transcript_ensembl_id as tx, least(genomic_start_tx, genomic_end_tx) as es, greatest(genomic_start_tx, genomic_end_tx) as ee from transcript_exon e join transcripts t on t.transcript_ensembl_id = e.transcript_ensembl_id) w
 on w.gene = q.gene group by ord, cluster, tx, l, r) where boundary or inside"""


def _matching(t, junctions):
    e = t["transcript_exon"].join(t["transcripts"].select("transcript_ensembl_id", F.col("gene_ensembl_id").alias("gene")), "transcript_ensembl_id")
    e = e.select("gene", F.col("transcript_ensembl_id").alias("tx"), F.col("genomic_start_tx").alias("gs"), F.col("genomic_end_tx").alias("ge"))
    return layout.matching_junctions(junctions, e)


@_query("matching_junctions", _sql(_MJ, "j"))
def _(t):
    return _matching(t, core.parse_junctions(t["junctions"]))


_JD = "select cluster, ord, row_number() over (partition by cluster order by ord) as idx, (row_number() over (partition by cluster order by ord) - 1) % 48 as color from {}"
_BR = """select ord, cluster, tx, "left", "right", idx, color, slot, round(least(0.95, 0.75 + (slot - 1) * 0.08::double), 6) as top from
 (select m.*, idx, color, row_number() over (partition by m.cluster, tx order by "left", "right", idx) as slot from ({}) m join ({}) jd on jd.cluster = m.cluster and jd.ord = m.ord)"""


@_query("junction_brackets", _sql(_BR.format(_MJ, _JD.format("j")), "j"))
def _(t):
    numbers = layout.junction_numbers(core.parse_junctions(t["junctions"]).select("ord", "cluster", "gene", "start", "end"))
    drawn = layout.junction_brackets(_matching(t, numbers))
    return drawn.select("ord", "cluster", "tx", "left", "right", "idx", "color", "slot", *_r("top"))


_EP = """select tx, part, cast(s as bigint) as "start", cast(e as bigint) as "end" from (
 select tx, case when own then 'coding' else 'untranslated' end as part, s, e from q where not (has and b > a)
 union all select tx, 'left_utr', s, a from q where has and b > a and s < a
 union all select tx, 'coding', a, b from q where has and b > a
 union all select tx, 'right_utr', b, e from q where has and b > a and b < e)"""
_EP_CTE = """q as (select t.transcript_ensembl_id as tx, least(genomic_start_tx, genomic_end_tx) as s, greatest(genomic_start_tx, genomic_end_tx) as e, abs_start_CDS > 0 and abs_end_CDS >= abs_start_CDS as own,
 cds_start > 0 and cds_end > 0 as has, greatest(least(genomic_start_tx, genomic_end_tx), least(cds_start, cds_end)) as a, least(greatest(genomic_start_tx, genomic_end_tx), greatest(cds_start, cds_end)) as b
 from transcript_exon x join transcripts t on t.transcript_ensembl_id = x.transcript_ensembl_id)"""


@_query("exon_cds_utr_segments", _sql(_EP, more=_EP_CTE))
def _(t):
    return layout.exon_parts(t["transcript_exon"], t["transcripts"])


_TD_CTE = "td as (select t.transcript_ensembl_id as tx, pd.AA_start, pd.AA_end, pd.position from pd join transcripts t on t.protein_ensembl_id = pd.protein where pd.AA_start is not null and pd.AA_end is not null)"
_DS = """select td.tx, AA_start, AA_end, td.position as domain, cs.position as segment, greatest(AA_start, start_aa) as start_aa, least(AA_end, end_aa) as end_aa
 from td join cs on cs.tx = td.tx where greatest(AA_start, start_aa) < least(AA_end, end_aa)"""


def _domains_of_transcripts(t):
    d = layout.protein_sites(t["domain_event"], t["domain_type"].select("type_id")).filter("AA_start is not null and AA_end is not null")
    tx = t["transcripts"].select(F.col("transcript_ensembl_id").alias("tx"), F.col("protein_ensembl_id").alias("protein"))
    return d.join(tx, "protein").select("tx", "AA_start", "AA_end", "position")


@_query("domain_segment_overlap", _sql(f"select tx, AA_start, AA_end, domain, segment, round(start_aa, 6) as start_aa, round(end_aa, 6) as end_aa from ({_DS})", more=f"{_PD_CTE}, {_CS_CTE}, {_TD_CTE}"))
def _(t):
    hits = layout.domain_segments(_domains_of_transcripts(t), layout.coding_segments(t["transcript_exon"]))
    return hits.select("tx", "AA_start", "AA_end", "domain", "segment", *_r("start_aa", "end_aa"))


_AX = """ax as (select gene_ensembl_id, case when m > 0 then m else 1.0 end as axis_max from (select gene_ensembl_id, max(greatest(0.0, protein_length, s, dd)) as m from transcripts t
 left join (select tx, max(end_aa) as s from cs group by tx) c on c.tx = t.transcript_ensembl_id left join (select tx, cast(max(AA_end) as double) as dd from td group by tx) e on e.tx = t.transcript_ensembl_id group by gene_ensembl_id))"""
_AXIS_CTES = f"{_PD_CTE}, {_CS_CTE}, {_TD_CTE}, {_AX}"


def _axis(t):
    return layout.gene_axis(t["transcripts"], layout.coding_segments(t["transcript_exon"]), _domains_of_transcripts(t))


@_query("gene_axis_max", _sql("select gene_ensembl_id, round(axis_max, 6) as axis_max from ax", more=_AXIS_CTES))
def _(t):
    return _axis(t).select("gene_ensembl_id", *_r("axis_max"))


_ST = """select tx, domain, strip, round(center, 6) as center, round(0.25 * sqrt(1 - x * x), 4) as strip_height, coalesce((select min(h.segment) from ds h where h.tx = w.tx and h.domain = w.domain and h.start_aa <= center and center <= h.end_aa), first) as segment from
 (select *, (center - (AA_start + AA_end) / 2.0) / (width / 2.0) as x from (select *, AA_start + (strip + 0.5) * (width / 80.0) as center from
 (select g.*, cast(unnest(range(0, 80)) as bigint) as strip, greatest(cast(AA_end - AA_start as double), 8.0, axis_max * 0.02::double) as width from
 (select ds.tx, domain, AA_start, AA_end, min(segment) as first from ds group by all having count(*) > 1) g join transcripts t on t.transcript_ensembl_id = g.tx join ax on ax.gene_ensembl_id = t.gene_ensembl_id))) w where abs(x) < 1"""


@_query("domain_strips", _sql(_ST, more=f"{_AXIS_CTES}, ds as ({_DS})"))
def _(t):
    hits = layout.domain_segments(_domains_of_transcripts(t), layout.coding_segments(t["transcript_exon"]))
    axis = t["transcripts"].select(F.col("transcript_ensembl_id").alias("tx"), "gene_ensembl_id").join(_axis(t), "gene_ensembl_id").select("tx", "axis_max")
    return layout.domain_strips(hits, axis).select("tx", "domain", "strip", *_r("center"), F.round("strip_height", 4).alias("strip_height"), "segment")


_PT_CTE = "pt as (select t.transcript_ensembl_id as protein, AA_start, AA_end, position, interpro, pfam, cdd, smart from pd join transcripts t on t.protein_ensembl_id = pd.protein)"
_IT_CTE = f"""it as (select *, row_number() over (partition by key order by center, text) as k, greatest(width * 0.25::double, length(text) * 2.2::double) as half, greatest(3.0::double, axis_max * 0.004::double) as gap from
 (select i.protein as key, (i.AA_start + i.AA_end) / 2.0::double as center, greatest(1.0::double, cast(i.AA_end - i.AA_start as double)) as width,
 case when has_overlap and not ends_with(label, '*') then label || '*' else label end as text, axis_max from ({_ISL.replace("from pd ", "from pt ")}) i
 join ({_LABEL_SQL.replace("from pd))", "from pt))").replace("count(*) over (partition by protein) > 1 as many", "false as many")}) l on l.protein = i.protein and l.position = i.position
 join transcripts t on t.transcript_ensembl_id = i.protein join ax on ax.gene_ensembl_id = t.gene_ensembl_id where label is not null))"""
_LANES_CTE = """lanes as (select key, cast(0 as bigint) as k, [-1e12::double, -1e12::double, -1e12::double, -1e12::double] as ends, cast(0 as bigint) as lane, null::double as center, null::varchar as text from (select distinct key from it)
 union all select key, k, list_transform(ends, lambda e, i: case when i = lane then center + half + gap else e end), lane, center, text from
 (select it.key, it.k, it.center, it.text, it.half, it.gap, lanes.ends,
  coalesce(nullif(list_position(list_transform(lanes.ends, lambda e: e <= it.center - it.half), true), 0), list_position(lanes.ends, list_min(lanes.ends))) as lane from lanes join it on it.key = lanes.key and it.k = lanes.k + 1) n)"""


def _tx_axis(t):
    return t["transcripts"].select(F.col("transcript_ensembl_id").alias("tx"), "gene_ensembl_id").join(_axis(t), "gene_ensembl_id").select("tx", "axis_max")


@_query("label_lanes", _sql("select key, round(center, 6) as center, text, lane - 1 as lane from lanes where k > 0", more=f"{_AXIS_CTES}, {_PT_CTE}, {_IT_CTE}, {_LANES_CTE}").replace("with ", "with recursive ", 1))
def _(t):
    tx = t["transcripts"].select(F.col("transcript_ensembl_id").alias("key"), F.col("protein_ensembl_id").alias("protein"))
    domains = layout.protein_sites(t["domain_event"], t["domain_type"].select("type_id")).join(tx, "protein").drop("protein")
    placed = layout.label_lanes(layout.island_labels(domains, _tx_axis(t).withColumnRenamed("tx", "key"), t["domain_type"]))
    return placed.select("key", *_r("center"), "text", F.col("lane").cast("bigint").alias("lane"))


_SHAPES = """select d.tx, d.domain, z, (AA_start + AA_end) / 2.0::double as center, round(greatest(cast(AA_end - AA_start as double), 8.0::double, axis_max * 0.02::double), 6) as width,
 case when n is null then 'fallback' when n = 1 then 'solid' else 'strips' end as fill, case when n is null then z % 48 when n = 1 then own end as color from
 (select td.*, td.position as domain, row_number() over (partition by td.tx order by AA_end desc, td.position) - 1 as z from td) d
 join transcripts t on t.transcript_ensembl_id = d.tx join ax on ax.gene_ensembl_id = t.gene_ensembl_id
 left join (select ds.tx, ds.domain, count(*) as n, min(color) as own from ds join cs on cs.tx = ds.tx and cs.position = ds.segment join transcripts g on g.transcript_ensembl_id = cs.tx
  left join ec on ec.gene_ensembl_id = g.gene_ensembl_id and ec.gs = cs.gs and ec.ge = cs.ge group by 1, 2) o on o.tx = d.tx and o.domain = d.domain"""


@_query("protein_view_domains", _sql(_SHAPES, more=f"{_AXIS_CTES}, ds as ({_DS}), ec as ({_EC})"))
def _(t):
    segments, domains = layout.coding_segments(t["transcript_exon"]), _domains_of_transcripts(t)
    colors = layout.segment_colors(segments, t["transcripts"], layout.exon_colors(t["transcript_exon"], t["transcripts"]))
    return layout.domain_shapes(domains, layout.domain_segments(domains, segments), colors, _tx_axis(t)).select("tx", "domain", "z", "center", *_r("width"), "fill", "color")


@_query(
    "protein_backbone_segments",
    _sql(
        "select tx, position, round(s, 6) as start_aa, round(e, 6) as end_aa from (select cs.tx, position, greatest(0.0, start_aa) as s, least(end_aa, least(axis_max, coalesce(protein_length, axis_max))) as e "
        "from cs join transcripts t on t.transcript_ensembl_id = cs.tx join ax on ax.gene_ensembl_id = t.gene_ensembl_id) where e > s",
        more=_AXIS_CTES,
    ),
)
def _(t):
    return layout.backbone_segments(layout.coding_segments(t["transcript_exon"]), t["transcripts"], _axis(t)).select("tx", "position", *_r("start_aa", "end_aa"))


_EX = "select gene_ensembl_id, cast(min(tx_start) as bigint) as genomic_start, cast(max(tx_end) as bigint) as genomic_end, count(*) as n_transcripts from transcripts group by 1"


@_query("gene_extents", _sql(_EX))
def _(t):
    return layout.gene_extents(t["transcripts"])


@_query(
    "transcript_filters",
    _sql(
        f"select gene_ensembl_id, t.transcript_ensembl_id as tx, t.transcript_ensembl_id in (select transcript_ensembl_id from transcript_exon) as has_exons, "
        f"{_P('t.protein_ensembl_id')} and lower(trim(t.protein_ensembl_id)) <> 'nan' as has_protein, "
        "t.transcript_ensembl_id in (select fp.tx from (select transcript_ensembl_id as tx, min(protein_ensembl_id) as protein from proteins where protein_ensembl_id is not null group by 1) fp where fp.protein in (select protein from pd)) as has_domains from transcripts t",
        more=_PD_CTE,
    ),
)
def _(t):
    return layout.transcript_flags(t["transcripts"], t["transcript_exon"], t["proteins"], layout.protein_domains(t["domain_event"], t["domain_type"]))


@_query("layout_pages", _sql(f"select gene_ensembl_id, tx, (position - 1) // 4 as page, (position - 1) % 4 as slot from ({_TO})"))
def _(t):
    return layout.pages(t["transcripts"])


@_query(
    "gene_title",
    _sql(
        "select g.gene_ensembl_id, gene_symbol || ' - ' || specie || '  |  chr' || chromosome || ':' || format('{:,}', genomic_start) || '-' || format('{:,}', genomic_end) || '  |  ' || n_transcripts || ' transcript(s)' as title "
        f"from genes g join ({_EX}) e on e.gene_ensembl_id = g.gene_ensembl_id"
    ),
)
def _(t):
    return layout.titles(t["genes"], layout.gene_extents(t["transcripts"]))


@_query("strand_flag", _sql(r"select gene_ensembl_id, coalesce(starts_with(lower(regexp_replace(strand, '^\s+|\s+$', '', 'g')), '-') or lower(regexp_replace(strand, '^\s+|\s+$', '', 'g')) = 'minus', false) as negative from genes"))
def _(t):
    return t["genes"].select("gene_ensembl_id", scalars.negative_strand(F.col("strand")).alias("negative"))


_AN = lambda v, u: f"regexp_replace(regexp_replace(printf('%.3f', round_even({v}, case when abs({v}) >= 1000 then 0 when abs({v}) >= 100 then 1 when abs({v}) >= 10 then 2 else 3 end)), '0+$', ''), '\\.$', '') || '{u}'"


@_query(
    "axis_number_format",
    _sql(
        f"select n, case when abs(n) >= 1000000 then {_AN('(n / 1000000.0::double)', 'M')} when abs(n) >= 1000 then {_AN('(n / 1000.0::double)', 'K')} else cast(cast(n as bigint) as varchar) end as label "
        "from (select distinct tx_start * tx_end * (tx_start % 5) - 1000 as n from transcripts union select distinct tx_start from transcripts)"
    ),
)
def _(t):
    n = t["transcripts"].select((F.col("tx_start") * F.col("tx_end") * (F.col("tx_start") % 5) - 1000).alias("n")).union(t["transcripts"].select("tx_start")).distinct()
    return n.select("n", scalars.axis_number(F.col("n")).alias("label"))


_SHOWN = ["junction_name", "gene_id", '"start"', '"end"', "comparison_results", "domain_descriptions", "cluster", "gene_name"]
_JT = f"""select ord, cast(row_number() over (partition by cluster order by ord) as varchar) as idx, {", ".join(f"coalesce(cast({c} as varchar), '') as {c}" for c in _SHOWN)},
 (row_number() over (partition by cluster order by ord) - 1) % 48 as color from ({_REPORT})"""


@_query("junction_table", _sql(_JT, "f"))
def _(t):
    return layout.junction_table(stages(t).report)


#: Transcripts with exons, a protein and a domain.
_DR_CTE = f"""dr as (select t.* from transcripts t where t.gene_ensembl_id in (select gene_ensembl_id from genes) and t.transcript_ensembl_id in (select transcript_ensembl_id from transcript_exon) and {_P("t.protein_ensembl_id")} and lower(trim(t.protein_ensembl_id)) <> 'nan'
 and t.transcript_ensembl_id in (select tx from (select transcript_ensembl_id as tx, min(protein_ensembl_id) as protein from proteins where protein_ensembl_id is not null group by 1) where protein in (select protein from pd)))"""
_PG_CTE = "pg as (select *, (n - 1) // 4 as page, (n - 1) % 4 as slot from (select *, row_number() over (partition by gene_ensembl_id order by tx_start, transcript_ensembl_id) as n from dr))"


@_query(
    "layout_pages_filtered",
    _sql(
        f"select gene_ensembl_id, transcript_ensembl_id as tx, page, slot, 'Transcript: ' || transcript_ensembl_id || '  |  Protein: ' || case when {_P('protein_ensembl_id')} then protein_ensembl_id else 'N/A' end as caption from pg",
        more=f"{_PD_CTE}, {_DR_CTE}, {_PG_CTE}",
    ),
)
def _(t):
    return gene_layout(t, protein_only=True, domains_only=True).captioned.select("gene_ensembl_id", "tx", "page", "slot", "caption")


_TITLES = """select g.gene_ensembl_id, page, gene_symbol || ' - ' || specie || '  |  chr' || chromosome || ':' || format('{:,}', a) || '-' || format('{:,}', b) || '  |  ' || n || ' transcript(s)'
 || '  |  clu_' || g.gene_ensembl_id || case when pages > 1 then '  (page ' || (page + 1) || '/' || pages || ')' else '' end as title
 from genes g join (select gene_ensembl_id, min(tx_start) as a, max(tx_end) as b, count(*) as n, max(page) + 1 as pages from pg group by 1) e on e.gene_ensembl_id = g.gene_ensembl_id
 join (select distinct gene_ensembl_id, page from pg) p on p.gene_ensembl_id = g.gene_ensembl_id"""


@_query("page_titles", _sql(_TITLES, more=f"{_PD_CTE}, {_DR_CTE}, {_PG_CTE}"))
def _(t):
    clusters = t["genes"].select("gene_ensembl_id", F.concat(F.lit("clu_"), "gene_ensembl_id").alias("cluster_name"))
    return gene_layout(t, protein_only=True, domains_only=True, clusters=clusters)["pages"]


@_query("gene_layout_by_name", _sql(_TITLES.replace("gene_symbol ||", "'customer#000000007' ||").replace(" || '  |  clu_' || g.gene_ensembl_id", "") + " where lower(gene_symbol) = 'customer#000000007'", more=f"{_PD_CTE}, {_DR_CTE}, {_PG_CTE}"))
def _(t):
    return gene_layout(t, "customer#000000007", protein_only=True, domains_only=True)["pages"]


#: The layout of drawn transcripts alone: their axes, segments, hits and colours.
_DRAWN = lambda q: re.sub(r"\btranscripts t\b", "dr t", q)
_LAYOUT_CTES = f"""{_PD_CTE}, {_DR_CTE}, {_PG_CTE}, cs as (select c.* from ({_CS}) c join dr on dr.transcript_ensembl_id = c.tx), {_DRAWN(_TD_CTE)}, {_DRAWN(_AX)},
 ds as ({_DS}), ec as (select * from ({_EC}) where gene_ensembl_id in (select gene_ensembl_id from genes))"""
_CAPTION = f"'Transcript: ' || transcript_ensembl_id || '  |  Protein: ' || case when {_P('protein_ensembl_id')} then protein_ensembl_id else 'N/A' end as caption"


def _layout(t):
    return gene_layout(t, protein_only=True, domains_only=True)


@_query("layout_transcripts", _sql(f"select pg.gene_ensembl_id, transcript_ensembl_id as tx, page, slot, {_CAPTION}, round(axis_max, 6) as axis_max from pg join ax on ax.gene_ensembl_id = pg.gene_ensembl_id", more=_LAYOUT_CTES))
def _(t):
    return _layout(t)["transcripts"].select("gene_ensembl_id", "tx", "page", "slot", "caption", *_r("axis_max"))


@_query("layout_exon_parts", _sql(_EP, more=f"{_PD_CTE}, {_DR_CTE}, {_DRAWN(_EP_CTE)}"))
def _(t):
    return _layout(t)["exon_parts"]


@_query("layout_exon_colors", _sql("select * from ec", more=_LAYOUT_CTES))
def _(t):
    return _layout(t)["exon_colors"]


_BACKBONE = """select cs.tx, position, round(greatest(0.0, start_aa), 6) as start_aa, round(least(end_aa, least(axis_max, coalesce(protein_length, axis_max))), 6) as end_aa
 from cs join transcripts t on t.transcript_ensembl_id = cs.tx join ax on ax.gene_ensembl_id = t.gene_ensembl_id where least(end_aa, least(axis_max, coalesce(protein_length, axis_max))) > greatest(0.0, start_aa)"""


@_query("layout_backbone", _sql(_DRAWN(_BACKBONE), more=_LAYOUT_CTES))
def _(t):
    return _layout(t)["backbone"].select("tx", "position", *_r("start_aa", "end_aa"))


@_query("layout_shapes", _sql(_DRAWN(_SHAPES), more=_LAYOUT_CTES))
def _(t):
    return _layout(t)["shapes"].select("tx", "domain", "z", "center", *_r("width"), "fill", "color")


@_query("layout_strips", _sql(_DRAWN(_ST), more=_LAYOUT_CTES))
def _(t):
    return _layout(t)["strips"].select("tx", "domain", "strip", *_r("center"), F.round("strip_height", 4).alias("strip_height"), "segment")


@_query(
    "layout_labels",
    _sql("select key, round(center, 6) as center, text, lane - 1 as lane from lanes where k > 0", more=f"{_LAYOUT_CTES}, {_DRAWN(_PT_CTE)}, {_DRAWN(_IT_CTE)}, {_LANES_CTE}").replace("with ", "with recursive ", 1),
)
def _(t):
    return _layout(t)["labels"].select("key", *_r("center"), "text", F.col("lane").cast("bigint").alias("lane"))


_KINDS = {"exon": "n_exon_parts", "segment": "n_segments", "strip": "n_strips", "domain": "n_domains", "transcript": "n_transcripts"}


def _elements():
    """How many elements of each kind a document has."""
    return [F.regexp_count("svg", F.lit(f'class="{kind}"')).cast("bigint").alias(name) for kind, name in _KINDS.items()]


_COUNTED = {
    "n_exon_parts": f"select tx, count(*) as n from (select distinct * from ({_EP})) group by tx", "n_segments": f"select tx, count(*) as n from ({_DRAWN(_BACKBONE)}) group by tx",
    "n_strips": f"select tx, count(*) as n from ({_DRAWN(_ST)}) group by tx", "n_domains": "select tx, count(*) as n from td group by tx", "n_transcripts": "select transcript_ensembl_id as tx, 1 as n from dr",
}


@_query(
    "page_documents",
    _sql(
        f"select pg.gene_ensembl_id, page, {', '.join(f'cast(sum(coalesce({name}.n, 0)) as bigint) as {name}' for name in _COUNTED)} from pg "
        + " ".join(f"left join ({q}) {name} on {name}.tx = pg.transcript_ensembl_id" for name, q in _COUNTED.items())
        + " group by 1, 2",
        more=f"{_LAYOUT_CTES}, {_DRAWN(_EP_CTE)}",
    ),
)
def _(t):
    return page_documents(_layout(t)).select("gene_ensembl_id", "page", *_elements())


_ASKED = "G7, G17,G27.2 ,G12,G13,G101"
_FIRST = "(select cluster, split_part(arg_min(gene_raw, ord), ':', 1) as g from u group by cluster)"
#: Clusters that are drawn, and the gene that their first junction's gene has by its symbol.
_OV_CTES = f"""{_PD_CTE}, ov as (select c.cluster, s.gene_ensembl_id from {_FIRST} c join genes g on g.gene_ensembl_id = c.g
 join (select lower(gene_symbol) as k, min(gene_ensembl_id) as gene_ensembl_id from genes group by 1) s on s.k = lower(g.gene_symbol) where c.g in {_SOME}), {_DR_CTE}, {_PG_CTE}"""
_OVERLAY = (
    _MJ.replace("select ord, cluster, gene, least", "select ord, u.cluster, ov.gene_ensembl_id as gene, least").replace("from j)", "from u join ov on ov.cluster = u.cluster)").replace("transcripts t on", "dr t on")
)


def _overlay(t):
    return overlay(t, requested_report(t, _ASKED))


@_query("overlay_brackets", _sql(_BR.format(_OVERLAY, _JD.format("u")), "f", _OV_CTES))
def _(t):
    return _overlay(t)["brackets"].select("ord", "cluster", "tx", "left", "right", "idx", "color", "slot", *_r("top"))


@_query("overlay_drawings", _sql("select * from ov", "u", _OV_CTES))
def _(t):
    return _overlay(t)["drawings"]


@_query("overlay_pages", _sql(_TITLES.replace(" || '  |  clu_' || g.gene_ensembl_id", "") + " where g.gene_ensembl_id in (select gene_ensembl_id from ov)", "u", _OV_CTES))
def _(t):
    return _overlay(t)["pages"]


@_query("overlay_junction_table", _sql(_JT.replace(f"from ({_REPORT})", f"from ({_REPORT}) where cluster in (select cluster from ov)"), "f", _OV_CTES))
def _(t):
    return _overlay(t)["junction_table"]


_CSV = ["cluster", "gene_name", "junction_name", "gene_id", '"start"', '"end"', "comparison_results", "domain_descriptions"]


@_query("report_csv", _sql(f"select {', '.join(f'coalesce(cast({c} as varchar), {chr(39) * 2}) as {c}' for c in _CSV)} from ({_REPORT})", "f"))
def _(t):
    """The report as one CSV file, read again: all text, nulls empty."""
    spark, report = t.spark, stages(t).report
    path = f"{shared_folder(spark)}/splicelake/report-{uuid.uuid4().hex}.csv"
    write_report(report, path)
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
