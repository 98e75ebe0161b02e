"""Annotation tables: schemas, readers, and stand-ins made from the driver's tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import exists, stored

#: Columns that each table must have; further ones are let be.
SCHEMAS = {
    "genes": "gene_ensembl_id string, gene_symbol string, specie string, chromosome string, strand string",
    "transcripts": "transcript_ensembl_id string, gene_ensembl_id string, protein_ensembl_id string, tx_start bigint, tx_end bigint, cds_start bigint, cds_end bigint, protein_length double",
    "proteins": "transcript_ensembl_id string, protein_ensembl_id string",
    "transcript_exon": "transcript_ensembl_id string, exon_rank bigint, genomic_start_tx bigint, genomic_end_tx bigint, abs_start_CDS bigint, abs_end_CDS bigint",
    "domain_event": "protein_ensembl_id string, type_id bigint, AA_start bigint, AA_end bigint",
    "domain_type": "type_id bigint, cdd string, pfam string, smart string, tigr string, interpro string, CDD_id string, description string",
    "junctions": "ord bigint, cluster string, ensembl_h string, h_junction string",
}

# Fixed texts, portable between SQL engines: each view reads the driver's tables or views before it.
VIEWS = {
    "genes": """select concat('G',cast(c_custkey as varchar(20))) as gene_ensembl_id, c_name as gene_symbol, c_mktsegment as specie, cast(c_nationkey as varchar(20)) as chromosome,
 case when c_custkey%3=0 then '-' when c_custkey%3=1 then '+' end as strand from customer""",
    "transcripts": """select concat('T',cast(o_orderkey as varchar(20))) as transcript_ensembl_id, concat('G',cast(o_custkey as varchar(20))) as gene_ensembl_id,
 case when o_orderstatus='P' then null when o_orderkey%50=0 then '' else concat('P',cast(o_orderkey as varchar(20))) end as protein_ensembl_id,
 1000+o_orderkey%300 as tx_start, 8000+o_orderkey%700 as tx_end,
 case when o_orderkey%9=0 then 0 else 1500 end as cds_start, case when o_orderkey%9=0 then 0 else 7200 end as cds_end,
 case when o_orderkey%4=0 then null else cast(500+o_orderkey%200 as double) end as protein_length from orders""",
    "proteins": "select transcript_ensembl_id, protein_ensembl_id from transcripts",
    "line1": "select l_orderkey,l_linenumber,min(l_partkey) as pk,cast(min(l_quantity) as bigint) as q,min(l_returnflag) as rf from lineitem group by l_orderkey,l_linenumber",
    "transcript_exon": """select concat('T',cast(l_orderkey as varchar(20))) as transcript_ensembl_id, cast(case when l_orderkey%6=0 then 8-l_linenumber else l_linenumber end as bigint) as exon_rank,
 l_linenumber*1000+pk%40 as genomic_start_tx, l_linenumber*1000+pk%40+case when q<=10 then q%2 else q*10 end as genomic_end_tx,
 case when rf='R' then 0 else cast(l_linenumber-1 as bigint)*300+1 end as abs_start_CDS, case when rf='R' then 0 else cast(l_linenumber-1 as bigint)*300+q*6 end as abs_end_CDS from line1""",
    "domain_event": """select concat('P',cast(l_orderkey as varchar(20))) as protein_ensembl_id, l_partkey as type_id,
 case when l_suppkey%20=0 then null else (l_linenumber-1)*100+l_suppkey%50 end as AA_start, (l_linenumber-1)*100+l_suppkey%50+cast(l_quantity as bigint)+case when l_partkey%3=0 then 90 else 0 end as AA_end from lineitem""",
    "domain_type": """select p_partkey as type_id, case when p_size%7=0 then p_name when p_size%7=1 then '' when p_size%7=2 then 'nan' end as cdd,
 case when p_size%7 in (1,3) then p_type when p_size%7=2 then '  ' end as pfam, case when p_size%7 in (2,4) then p_type end as smart,
 case when p_size%7=3 then p_brand end as tigr, case when p_size%7 in (4,5) then p_type end as interpro, case when p_size%7=5 then p_brand end as CDD_id,
 concat(p_brand,'; ',p_type) as description from part""",
    "junctions_ev": """select event_id as ord, case when event_id%101=0 then null else concat('clu_',cast(user_id as varchar(20)),'_',cast(event_id%3 as varchar(20))) end as cluster,
 concat('G',cast(user_id as varchar(20)),case when user_id%50=13 then '.2' when user_id%50=12 then 'x' else '' end) as ensembl_h,
 case when event_id%97=0 then -1 when event_id%5=0 then 1000*(1+event_id%7)+(event_id*37)%40 else 1000*(1+event_id%7)+(event_id*37)%700 end as s,
 case when event_id%5=0 then 1000*(1+event_id%7)+(event_id*37)%40 else 1000*(1+event_id%7)+(event_id*37)%700+200+cast(floor(value*20) as bigint) end as e
 from events""",
    "junctions_ex": """select 1000000000000+cast(substr(g,2) as bigint)*100000000+s*10000+e as ord, concat('clx_',g) as cluster, g as ensembl_h, s, e from
 (select distinct t.gene_ensembl_id as g, a.genomic_end_tx as s, b.genomic_start_tx as e from transcript_exon a join transcript_exon b on a.transcript_ensembl_id=b.transcript_ensembl_id and b.genomic_start_tx-b.genomic_start_tx%1000=a.genomic_start_tx-a.genomic_start_tx%1000+1000
  join transcripts t on t.transcript_ensembl_id=a.transcript_ensembl_id) d""",
    "junctions_in": """select distinct 1000000000000+cast(substr(t.gene_ensembl_id,2) as bigint)*100000000+a.genomic_end_tx*10000+a.genomic_start_tx as ord, concat('cly_',t.gene_ensembl_id) as cluster, t.gene_ensembl_id as ensembl_h,
 a.genomic_end_tx as s, a.genomic_start_tx as e from transcript_exon a join transcripts t on t.transcript_ensembl_id=a.transcript_ensembl_id where a.genomic_end_tx-a.genomic_start_tx<=1""",
    "junctions": """select cast(ord as bigint) as ord, cluster, ensembl_h, concat('chr1:',cast(s as varchar(20)),':',cast(e as varchar(20))) as h_junction from (select * from junctions_ev union all select * from junctions_ex union all select * from junctions_in) u""",
}
#: What the views of exons and junctions hold, as Spark plans with fewer shuffles: one of lines and one of exons.
PLANS: dict[str, Callable[[StandIns], DataFrame]] = {}
_RAW = ("customer", "orders", "lineitem", "part", "events")


def checked(df: DataFrame, name: str) -> DataFrame:
    """`df` with the columns of its schema cast to their types; a missing column is an error that names it."""
    fields = [x.strip().split(" ") for x in SCHEMAS[name].split(",")]
    missing = [c for c, _ in fields if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {', '.join(missing)}")
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in fields})


def read_tables(spark: SparkSession, folder: str, kind: str = "parquet", **options) -> dict[str, DataFrame]:
    """The annotation tables of a folder, one file or folder each, in a format that Spark reads."""
    suffix = "" if kind == "table" else f".{kind}"
    return {n: checked(spark.read.format(kind).options(**options).load(f"{folder}/{n}{suffix}"), n) for n in SCHEMAS}


def _line1(t: StandIns) -> DataFrame:
    """The view `line1`; of the flags only R is told, which is all that is asked of it. Numbers take a hash aggregate,
    where the least of texts sorts all lines before and after their shuffle."""
    flag = F.col("l_returnflag")
    order = F.when(flag < "R", 0).when(flag == "R", 1).when(flag > "R", 2)
    pk, q = F.min("l_partkey").alias("pk"), F.min("l_quantity").cast("bigint").alias("q")
    # An order's lines stay together, so that its exons lie in one file and meet before they are shuffled again.
    lines = t._raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag").repartition("l_orderkey")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(pk, q, F.when(F.min(order) == 1, F.lit("R")).alias("rf")).sortWithinPartitions("l_orderkey", "l_linenumber")


def _junctions(t: StandIns) -> DataFrame:
    """The view `junctions`: a transcript's few exons meet in one row, from which both kinds of pairs are taken."""
    exons = t["transcript_exon"].groupBy("transcript_ensembl_id").agg(F.collect_list(F.struct(F.col("genomic_start_tx").alias("gs"), F.col("genomic_end_tx").alias("ge"))).alias("exons"))
    thousand = lambda e: e["gs"] - e["gs"] % 1000
    place = lambda kind, s, e: F.struct(F.lit(kind).alias("kind"), s.alias("s"), e.alias("e"))
    after = F.flatten(F.transform("exons", lambda a: F.transform(F.filter("exons", lambda b: thousand(b) == thousand(a) + 1000), lambda b: place("clx_", a["ge"], b["gs"]))))
    inside = F.transform(F.filter("exons", lambda a: a["ge"] - a["gs"] <= 1), lambda a: place("cly_", a["ge"], a["gs"]))
    pairs = exons.join(t["transcripts"].select("transcript_ensembl_id", F.col("gene_ensembl_id").alias("ensembl_h")), "transcript_ensembl_id").select("ensembl_h", F.explode(F.concat(after, inside)).alias("p"))
    ex = pairs.select("ensembl_h", "p.*").distinct()
    number = F.lit(10**12) + F.substring("ensembl_h", 2, 99).cast("bigint") * 10**8 + F.col("s") * 10_000 + F.col("e")
    t._raw("events").createOrReplaceTempView("events")
    both = t.spark.sql(VIEWS["junctions_ev"]).unionByName(ex.select(number.alias("ord"), F.concat("kind", "ensembl_h").alias("cluster"), "ensembl_h", "s", "e"))
    junction = F.concat(F.lit("chr1:"), F.col("s").cast("string"), F.lit(":"), F.col("e").cast("string"))
    return both.select(F.col("ord").cast("bigint").alias("ord"), "cluster", "ensembl_h", junction.alias("h_junction"))


PLANS |= {"line1": _line1, "junctions": _junctions}


class StandIns(Mapping):
    """The tables as `VIEWS` makes them from the driver's, each made and written when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __iter__(self) -> Iterator[str]:
        return iter(SCHEMAS)

    def __len__(self) -> int:
        return len(SCHEMAS)

    def __or__(self, other: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {**self, **other}

    def __getitem__(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _written or not exists(_written[key]):
            _written[key] = stored(checked(self._made(name), name), f"stand-in-{name}")
        return _written[key]

    def _raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _made(self, name: str) -> DataFrame:
        if name in PLANS:
            return PLANS[name](self)
        sql = VIEWS[name]
        asked = {n for n in (*_RAW, *VIEWS) if n != name and re.search(rf"\b(from|join) {n}\b", sql)}
        made = {n: self[n] if n in SCHEMAS else self._made(n) if n in VIEWS else self._raw(n) for n in asked}
        for n, df in made.items():  # after all of them are made: names are shared
            df.createOrReplaceTempView(n)
        return self.spark.sql(sql)


#: What a session has written, by application, folder and name.
_written: dict[tuple[str, str, str], DataFrame] = {}


def stand_ins(spark: SparkSession, sf_dir: str) -> StandIns:
    return StandIns(spark, sf_dir)
