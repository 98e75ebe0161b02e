"""Joins of places, numbering, files and the layout plans: against brute force, skewed keys, and what the plans scan."""

import os
import random
import re
import time
import zipfile
from collections import Counter
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from splicelake.operators import core, layout
from splicelake.operators.joins import near_join, overlap_join
from splicelake.operators.numbering import numbered
from splicelake.plans.gene_layout import GeneLayout, gene_layout, overlay
from splicelake.plans.page_documents import escaped, page_documents
from splicelake.plans import report as report_plans
from splicelake.plans.report import cluster_report, requested, requested_report, stages
from splicelake.sources.annotation import read_clustered, write_clustered
from splicelake.sources.files import read_junction_sheet, read_xlsx, write_single_csv
from splicelake.sources.tables import SCHEMAS, stand_ins

from .test_report import make

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("width", [1, 7, 100, 10**6])
def test_overlap_join(spark, width):
    rng = random.Random(3)
    place = lambda: None if rng.random() < 0.05 else rng.randint(-60, 400)
    a = [(k, None if k % 17 == 0 else f"g{k % 3}", s, None if s is None else s + rng.choice([-40, 0, 3, 90])) for k, s in enumerate(place() for _ in range(80))]
    b = [(k, f"g{k % 3}", s, None if s is None else s + rng.choice([-5, 0, 20, 200])) for k, s in enumerate(place() for _ in range(80))]
    got = overlap_join(spark.createDataFrame(a, "i long, g string, s long, e long"), spark.createDataFrame(b, "j long, g string, x long, y long"), ["g"], ("s", "e", "x", "y"), width).collect()
    want = [(i, j) for i, g, s, e in a for j, h, x, y in b if g == h and None not in (s, e, x, y) and s <= y and e >= x]
    assert sorted((r["i"], r["j"]) for r in got) == sorted(want)


def test_near_join(spark):
    rng = random.Random(4)
    a, b = ([(k, f"g{k % 2}", None if k % 9 == 8 else rng.randint(0, 40)) for k in range(60)] for _ in range(2))
    got = near_join(spark.createDataFrame(a, "i long, g string, a long"), spark.createDataFrame(b, "j long, g string, b long"), ["g"], "a", "b").collect()
    assert sorted((r["i"], r["j"]) for r in got) == sorted((i, j) for i, g, x in a for j, h, y in b if g == h and None not in (x, y) and abs(x - y) <= 1)


def hot_gene(spark):
    """A gene with nine tenths of the junctions, along a long chromosome."""
    rng = random.Random(9)
    junctions = [(k, f"c{k % 50}", "H" if k % 10 else f"G{k % 7}", s := rng.randint(0, 10**6), s + rng.randint(0, 3000)) for k in range(4000)]
    exons = [(g, f"{g}t{t}", r, s := rng.randint(0, 10**6), s + 150, 1 + r, r, r + 50) for g in ("H", *(f"G{k}" for k in range(7))) for t in range(4) for r in range(60)]
    j = spark.createDataFrame([(k, c, g, g, "n", "1", s, e) for k, c, g, s, e in junctions], "ord long, cluster string, gene_raw string, gene string, junction_name string, chromosome string, start long, end long")
    return junctions, exons, j, spark.createDataFrame(exons, "gene string, tx string, exon_rank long, gs long, ge long, cds_start long, aa_start long, aa_end long")


def test_interval_join_of_a_hot_gene_spreads(spark):
    junctions, exons, j, x = hot_gene(spark)
    want = {}
    for k, _, g, s, e in junctions:
        for h, tx, _, gs, ge, _, a, b in exons:
            if g == h and gs <= e and ge >= s:
                lo, hi = want.get((k, tx), (10**9, -1))
                want[k, tx] = (min(lo, a), max(hi, b))
    assert {(r["ord"], r["tx"]): (r["aa_start"], r["aa_end"]) for r in core.nonskipping_aa_ranges(j, x).collect()} == want
    places = j.select("ord", "gene", F.col("start").alias("js"), F.col("end").alias("je")).filter("gene = 'H'")
    pairs = overlap_join(places.repartition(8).hint("merge"), x, ["gene"], ("js", "je", "gs", "ge"), 16_384)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = [r["n"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) > 1 and max(tasks) < 0.7 * sum(tasks)


@pytest.mark.parametrize("runs", [1, 5, None])
def test_numbered(spark, runs):
    rng = random.Random(2)
    rows = [("hot" if k % 3 else f"k{k % 5}" if k % 2 else None, k, rng.random()) for k in rng.sample(range(3000), 3000)]
    got = numbered(spark.createDataFrame(rows, "key string, ord long, x double"), ["key"], ["ord"], "n", runs).collect()
    place, want = Counter(), {}
    for key, k, x in sorted(rows, key=lambda r: r[1]):
        place[key] += 1
        want[k] = (key, x, place[key])
    assert {r["ord"]: (r["key"], r["x"], r["n"]) for r in got} == want


def test_numbering_of_a_hot_key_takes_many_tasks(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("key"), F.col("id").alias("ord"))
    out = numbered(df, ["key"], ["ord"], "n", 8)
    assert out.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()[:] == (1, 100_000, 100_000)
    assert out.filter("ord + 1 = n").count() == 100_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = [r["c"] for r in numbered(df, ["key"], ["ord"], "n", 8).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(tasks) > 1 and max(tasks) < 70_000


def test_lanes_of_many_labels(spark):
    items = spark.range(50_000).select(F.lit("k").alias("key"), (F.col("id") * 3.0).alias("center"), F.lit(10.0).alias("width"), F.lit("abc").alias("text"), F.lit(100.0).alias("axis_max"))
    start = time.time()
    assert layout.label_lanes(items).filter("lane between 0 and 3").count() == 50_000
    assert time.time() - start < 20


def book(path, header, rows):
    cell = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join('<row>' + ''.join(map(cell, r)) + '</row>' for r in [header, *rows])}</sheetData></worksheet>")


def test_workbooks_by_their_own_headers(spark, tmp_path):
    book(tmp_path / "a.xlsx", ["h_junction", "symbol_h", "ensembl_h", "rank_h", "cluster", "more"], [["1:1:2", "s", "G1", "1", "c1", "x"]])
    book(tmp_path / "b.xlsx", ["cluster", "rank_h", "ensembl_h", "symbol_h", "h_junction"], [["c2", "2", "G2", "t", "1:3:4"], ["c3", "3", "G3"]])
    got = read_junction_sheet(spark, str(tmp_path / "*.xlsx")).orderBy("ord").collect()
    assert [(r["h_junction"], r["ensembl_h"], r["cluster"]) for r in got] == [("1:1:2", "G1", "c1"), ("1:3:4", "G2", "c2"), (None, "G3", "c3")]
    assert len({r["ord"] for r in got}) == 3
    book(tmp_path / "c.xlsx", ["cluster"], [["c9"]])
    with pytest.raises(Exception, match="c.xlsx lacks h_junction"):
        read_junction_sheet(spark, str(tmp_path / "*.xlsx")).collect()


def test_workbook_of_many_rows_is_read_in_batches(spark, tmp_path):
    book(tmp_path / "a.xlsx", ["a", "b"], ([str(k), "v"] for k in range(45_000)))
    got = read_xlsx(spark, str(tmp_path / "a.xlsx"))
    assert got.agg(F.count("*"), F.sum(F.col("a").cast("long") - F.col("ord"))).first()[:] == (45_000, 0)


def test_one_csv_file(spark, tmp_path):
    out = str(tmp_path / "out.csv")
    df = spark.range(1000).repartition(7).orderBy("id").select("id", F.when(F.col("id") % 2 == 0, F.lit('say "a", b\nc')).otherwise(F.lit("")).alias("text"))
    write_single_csv(df, out)
    with open(out) as f:
        content = f.read()
    assert content.startswith("id,text\n0,") and content.count("id,text") == 1 and os.listdir(tmp_path) and not [x for x in os.listdir(tmp_path) if "parts" in x]
    back = spark.read.options(header=True, escape='"', multiLine=True).csv(out).collect()
    assert [int(r["id"]) for r in back] == list(range(1000)) and back[0]["text"] == 'say "a", b\nc' and back[1]["text"] in (None, "")
    write_single_csv(df.limit(0), out)
    with open(out) as f:
        assert f.read() == "id,text\n"


def test_progress_is_observed(spark):
    s = stages(stand_ins(spark, SF))
    s.report.count()
    counts = dict(s.counts)
    assert set(counts) == {"junctions", "usable", "domains", "exons", "ranges", "kept", "found"}
    assert counts["ranges"] == s.progress.agg(F.sum("n_transcripts")).first()[0]
    assert counts["usable"] == s.usable.count() and counts["junctions"] == s.junctions.count() and counts["kept"] == s.kept.count()


def two_genes(spark):
    """Cluster c1 starts with a junction of G1 and has one of G2; c2 is G2's."""
    rows = [(0, "c1", "G1", "1:199:500"), (1, "c1", "G2", "1:199:300"), (2, "c2", "G2", "1:199:300"), (3, "c3", "G3", "1:199:500")]
    t = make(spark, rows, [("G1", "SYMA", "human", "1", "+"), ("G2", "SYMB", "human", "1", "-")])
    more = {
        "transcripts": [("U1", "G2", "Q1", 50, 600, 100, 590, 90.0), ("V1", "G3", "R1", 50, 600, 100, 590, 90.0)], "proteins": [("U1", "Q1"), ("V1", "R1")],
        "transcript_exon": [("U1", 1, 100, 199, 1, 90), ("U1", 2, 300, 399, 91, 180), ("V1", 1, 100, 199, 1, 90)], "domain_event": [("Q1", 1, 5, 25), ("R1", 1, 5, 25)],
    }
    return t | {n: t[n].unionByName(spark.createDataFrame(r, SCHEMAS[n])) for n, r in more.items()}


def test_overlay_draws_requested_genes_alone(spark):
    t = two_genes(spark)
    drawn = overlay(t, requested(cluster_report(t), "G1"))
    assert [r["title"] for r in drawn["pages"].collect()] == ["SYMA - human  |  chr1:50-600  |  2 transcript(s)"]
    for name in ("transcripts", "exon_parts", "backbone", "shapes", "strips"):
        assert {r["tx"] for r in drawn[name].collect()} <= {"T1", "T2"}, name
    assert {r["key"] for r in drawn["labels"].collect()} == {"T1", "T2"}
    assert [tuple(r) for r in drawn["drawings"].collect()] == [("c1", "G1")]
    # G2's junction of the cluster is drawn over G1's transcripts, with its own number and colour.
    assert {(r["ord"], r["tx"], r["idx"], r["color"], r["slot"]) for r in drawn["brackets"].collect()} == {(0, "T2", 1, 0, 1), (1, "T1", 2, 1, 1)}
    assert [(r["idx"], r["gene_id"]) for r in drawn["junction_table"].orderBy("ord").collect()] == [("1", "G1"), ("2", "G2")]
    none = overlay(t, requested(cluster_report(t), "G3, G9"))  # G3 has no row among genes
    assert all(none[name].count() == 0 for name in none)


def test_requested_report_makes_the_chosen_clusters_alone(spark, monkeypatch):
    """It is what the whole report has of them, from their junctions and nothing of other genes."""
    runs = []
    monkeypatch.setattr(report_plans, "stages", lambda *a, **k: runs.append(stages(*a, **k)) or runs[-1])
    t = two_genes(spark)
    for asked in ("G1", " G2 ,G1", "G3, G9", "G0"):
        want = {tuple(r) for r in requested(cluster_report(t), asked).collect()}
        runs.clear()
        assert {tuple(r) for r in requested_report(t, asked).collect()} == want
    named = [r["cluster"] for r in t["junctions"].filter("ensembl_h = 'G1'").select("cluster").distinct().collect()]
    rows = t["junctions"].filter(F.col("cluster").isin(named)).count()
    runs.clear()
    requested_report(t, "G1").collect()
    assert 0 < runs[0].counts["junctions"] == rows < t["junctions"].count()


def test_overlay_of_a_shared_symbol(spark):
    t = two_genes(spark)
    t |= {"genes": t["genes"].withColumn("gene_symbol", F.when(F.col("gene_ensembl_id") == "G1", "SYMB").otherwise("symb"))}
    drawn = overlay(t, requested(cluster_report(t), "G2"))
    assert [tuple(r) for r in drawn["drawings"].collect()] == [("c2", "G1")]


def scans(df):
    plan = df._jdf.queryExecution().toString()
    return len(re.findall(r"\+- .*Scan|^ *:? *.*FileScan", plan.split("== Physical Plan ==")[1].split("== Initial Plan ==")[0], re.M))


def test_layout_tables_share_their_steps(spark):
    drawn = gene_layout(stand_ins(spark, SF), "customer#000000007", protein_only=True, domains_only=True)
    assert set(drawn) == set(GeneLayout.TABLES)
    for name in drawn:
        assert scans(drawn[name]) <= 10, name


def test_named_gene_is_what_all_genes_give(spark):
    t = stand_ins(spark, SF)
    every, one = gene_layout(t), gene_layout(t, "Customer#000000007")
    tx = one["transcripts"].select("tx")
    assert tx.count() > 0
    for name in ("exon_parts", "backbone", "shapes", "strips", "transcripts"):
        rows = lambda df: Counter(tuple(r) for r in df.collect())
        whole = every[name].join(tx, "tx", "left_semi").select(one[name].columns)
        assert rows(whole) == rows(one[name]), name
    assert Counter(map(tuple, every["exon_colors"].filter("gene_ensembl_id = 'G7'").collect())) == Counter(map(tuple, one["exon_colors"].collect()))


def test_clustered_tables_are_pruned(spark, tmp_path):
    t = stand_ins(spark, SF)
    write_clustered(t, str(tmp_path), row_group=1 << 14)
    stored = read_clustered(spark, str(tmp_path))
    a, b = gene_layout(t, "Customer#000000007"), gene_layout(stored, "Customer#000000007")
    for name in a:
        assert Counter(map(tuple, a[name].collect())) == Counter(map(tuple, b[name].select(a[name].columns).collect())), name
    plan = b._of_genes("transcript_exon")
    assert "PushedFilters: [IsNotNull(gene_ensembl_id), EqualTo(gene_ensembl_id,G7)]" in plan._jdf.queryExecution().toString() or "In(gene_ensembl_id, [G7])" in plan._jdf.queryExecution().toString()


def test_clustered_tables_where_a_protein_is_in_two_genes(spark, tmp_path):
    t = two_genes(spark)
    shared = {"proteins": [("U1", "P1")]}
    t |= {n: t[n].unionByName(spark.createDataFrame(r, SCHEMAS[n])) for n, r in shared.items()}
    write_clustered(t, str(tmp_path))
    for gene in ("SYMA", "SYMB"):
        a, b = gene_layout(t, gene), gene_layout(read_clustered(spark, str(tmp_path)), gene)
        assert a["shapes"].count() > 0
        for name in a:
            assert Counter(map(tuple, a[name].collect())) == Counter(map(tuple, b[name].select(a[name].columns).collect())), name


def test_layout_of_empty_tables(spark):
    t = {n: spark.createDataFrame([], SCHEMAS[n]) for n in SCHEMAS}
    drawn = gene_layout(t)
    assert all(drawn[name].count() == 0 for name in drawn)


def kinds(svg):
    return Counter(e.get("class") for e in ElementTree.fromstring(svg).iter())


def test_page_documents(spark):
    drawn = gene_layout(stand_ins(spark, SF), protein_only=True, domains_only=True)
    documents = page_documents(drawn).collect()
    assert len(documents) == drawn["pages"].count() and len({(r["gene_ensembl_id"], r["page"]) for r in documents}) == len(documents)
    total = sum((kinds(r["svg"]) for r in documents), Counter())
    for kind, name in (("exon", "exon_parts"), ("segment", "backbone"), ("domain", "shapes"), ("strip", "strips"), ("transcript", "transcripts")):
        assert total[kind] == drawn[name].count(), name
    assert total["t"] == 5 * len(documents) + drawn["transcripts"].count() + drawn["labels"].count()


def test_page_documents_of_an_overlay(spark):
    t = two_genes(spark)
    t |= {"genes": t["genes"].withColumn("gene_symbol", F.concat(F.lit("<&\"\x01"), "gene_symbol"))}
    drawn = overlay(t, requested(cluster_report(t), "G1,G2"))
    documents = {r["cluster"]: r["svg"] for r in page_documents(drawn).collect()}
    assert set(documents) == {"c1", "c2"}
    assert kinds(documents["c1"])["bracket"] == drawn["brackets"].filter("cluster = 'c1'").count() == 2
    assert '<&"SYMA - human' in next(e.text for e in ElementTree.fromstring(documents["c1"]).iter() if e.get("font-size") == "14")
    # G2 lies on the negative strand: its axis runs from right to left.
    ends = [e.text for e in ElementTree.fromstring(documents["c2"]).iter() if e.get("font-size") == "8"][:2]
    assert ends == ["600", "50"]


def test_escaped(spark):
    rows = spark.createDataFrame([("a<b>&\"c\x00\x1f\ufffe",), (None,)], "x string").select(escaped(F.col("x")).alias("x")).collect()
    assert [r["x"] for r in rows] == ["a&lt;b&gt;&amp;&quot;c", ""]


def test_stand_ins_are_made_once(spark):
    t = stand_ins(spark, SF)
    first = t["transcript_exon"]
    assert stand_ins(spark, SF)["transcript_exon"] is first and set(t) == set(SCHEMAS) and len(t) == len(SCHEMAS)
    assert stand_ins(spark, "/root/testdata/sf0.01")["genes"].count() != t["genes"].count()
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = jvm.Path(first._written)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    assert stand_ins(spark, SF)["transcript_exon"].count() > 0  # files that are gone are made again
