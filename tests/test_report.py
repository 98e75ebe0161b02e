"""The micro-fixture with its expected report, quirks one by one, and properties of the report."""

import os
import random
import sqlite3
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from splicelake.functions import scalars
from splicelake.operators import core, layout
from splicelake.__main__ import main, parser
from splicelake.plans.gene_layout import find_gene, gene_layout, overlay
from splicelake.plans.report import cluster_report, report_of_files, requested, stages
from splicelake.sources.files import DATABASE_TABLES, SHEET_COLUMNS, SQLiteSource, read_xlsx, write_single_csv
from splicelake.sources.tables import SCHEMAS, VIEWS, checked, stand_ins

J = [("J1", "c1", "G1", 199, 500), ("J2", "c1", "G1", 199, 300), ("J3", "c1", "G1", 210, 290), ("J4", "c2", "G1", 420, 599), ("J5", "c2", "G1", 199, 250), ("J6", "c3", "G1", 199, 300), ("J7", "c4", "GX", 1, 9)]


def make(spark, junctions=None, genes=None):
    rows = junctions or [(k, c, g, f"chr1:{s}:{e}") for k, (_, c, g, s, e) in enumerate(J)]
    kind = lambda name, d: {"cdd": "", "pfam": "", "smart": "", "tigr": "", "interpro": "", "CDD_id": ""} | {d: name}
    types = [(1, "Kinase", "cdd", "k"), (2, "SH3", "pfam", "s;1"), (3, "WD", "smart", "w")]
    t = {
        "genes": [("G1", "SYMA", "human", "1", "+")] if genes is None else genes,
        "transcripts": [("T1", "G1", "P1", 50, 600, 100, 590, 200.0), ("T2", "G1", "P2", 100, 600, 100, 590, None), ("T3", "G1", None, 300, 400, None, None, None)],
        "proteins": [("T1", "P1"), ("T2", "P2"), ("T3", None)],
        "transcript_exon": [("T1", 1, 50, 80, 0, 0), ("T1", 2, 100, 199, 1, 90), ("T1", 3, 300, 399, 91, 180), ("T1", 4, 500, 599, 181, 270), ("T2", 1, 100, 199, 1, 90), ("T2", 2, 500, 599, 91, 180), ("T3", 1, 300, 399, 1, 90)],
        "domain_event": [("P1", 1, 35, 55), ("P1", 2, 65, 85), ("P1", 2, 10, 18), ("P1", 3, 1, 20), ("P2", 2, 35, 50), ("P2", 3, 5, 20)],
        "domain_type": [(i, *kind(n, c).values(), d) for i, n, c, d in types],
        "junctions": rows,
    }
    return {n: spark.createDataFrame(t[n], SCHEMAS[n]) for n in SCHEMAS}


def lines(df):
    return {r["ord"]: (r["comparison_results"], r["domain_descriptions"]) for r in df.collect()}


def test_fixture(spark):
    got = lines(cluster_report(make(spark)))
    assert got == {
        0: ("Longer SH3, 21 vs 9", "s | 1"),
        1: ("Shorter SH3, 9 vs 21", "s | 1"),
        2: ("Missing Kinase, 21;Missing SH3, 21;Missing WD, 20", "k;s | 1;w"),
        3: ("Missing WD, 20;Longer SH3, 21 vs 9", "w;s | 1"),
        4: ("only has WD, 20;Shorter SH3, 9 vs 21", "w;s | 1"),
        5: ("Nothing to compare", "no description"),
    }


def test_ranges_and_kept(spark):
    s = stages(make(spark))
    assert {(r["ord"], r["tx"], r["aa_start"], r["aa_end"]) for r in s.ranges.collect()} == {
        (0, "T1", 0, 90), (0, "T2", 0, 60), (1, "T1", 0, 60), (1, "T2", 0, 30), (3, "T1", 60, 90), (3, "T2", 30, 60), (4, "T1", 0, 30), (4, "T2", 0, 30), (5, "T1", 0, 60), (5, "T2", 0, 30),
    }
    assert {(r["name"], r["len"]) for r in s.kept.filter("ord = 1").collect()} == {("Kinase", 21), ("SH3", 9), ("WD", 20)}


def test_versioned_gene_has_exons_but_no_domains(spark):
    rows = [(0, "c", "G1", "1:199:500"), (1, "c", "G1.7", "1:199:500")]
    got = lines(cluster_report(make(spark, rows)))
    assert got[1][0] == "Missing Kinase, 21;Missing SH3, 21;Missing WD, 20"
    assert lines(cluster_report(make(spark, rows), normalize_gene_id=True))[1] == ("", "")


def test_malformed_rows(spark):
    rows = [(0, "c", "G1", "1:199:500"), (1, "c", "G1", "1:199"), (2, "c", "G1", "1:a:b"), (3, None, "G1", "1:1:2"), (4, "c", "G1", "1:-1:5"), (5, "c", None, "1:1:5")]
    t = make(spark, rows)
    assert [r["ord"] for r in core.parse_junctions(t["junctions"], on_error="drop").collect()] == [0]
    with pytest.raises(Exception, match="not a junction"):
        core.parse_junctions(t["junctions"]).collect()


def test_skipping_needs_one_exon_at_both_ends(spark):
    exons = spark.createDataFrame([("G", "T", 1, 100, 101, 1, 0, 3), ("G", "U", 1, 50, 90, 1, 0, 3)], "gene string, tx string, exon_rank long, gs long, ge long, cds_start long, aa_start long, aa_end long")
    j = spark.createDataFrame([(1, "c", "G", "G", "n", "1", 100, 101)], "ord long, cluster string, gene_raw string, gene string, junction_name string, chromosome string, start long, end long")
    assert [tuple(r) for r in core.skipping_transcripts(j, exons).collect()] == [(1, "T")]
    assert core.nonskipping_aa_ranges(j, exons).count() == 0


def test_supporting(spark):
    s = stages(make(spark))
    got = {(r["ord"], r["tx"]) for r in core.supporting_transcripts(s.usable, s.exons).collect()}
    assert got == {(0, "T2"), (1, "T1"), (5, "T1")}
    assert core.supporting_transcripts(s.usable, s.exons, strict=True).count() == 0


def test_gene_name(spark):
    rows = [(0, "c", "G1", "1:199:500")]
    name = lambda genes: cluster_report(make(spark, rows, genes)).first()["gene_name"]
    assert name([("G1", "S", None, None, None)]) == "S" and name([("G2", "S", None, None, None)]) == "G1" and name([("G1", None, None, None, None)]) is None


def test_null_names(spark):
    row = spark.createDataFrame([(None, " ", "nan", "\t", None, None)], "cdd string, pfam string, smart string, tigr string, interpro string, CDD_id string")
    assert row.select(scalars.first_valid_name()).first()[0] is None
    assert row.select(scalars.first_valid_name("None")).first()[0] == "None"


def test_properties(spark):
    t = stand_ins(spark, "/root/testdata/sf0.001")
    s = stages(t)
    rows = s.report.collect()
    assert len(rows) == s.usable.count()
    assert s.kept.groupBy("ord", "name").count().filter("count > 1").count() == 0
    for r in rows:
        assert r["comparison_results"].count(";") == r["domain_descriptions"].count(";")
    mixed = t["junctions"].collect()
    random.Random(1).shuffle(mixed)
    again = cluster_report(t | {"junctions": spark.createDataFrame(mixed, SCHEMAS["junctions"])})
    assert lines(again) == lines(s.report)
    opposite = {"only has": "Missing", "Missing": "only has", "Longer": "Shorter", "Shorter": "Longer"}
    pairs = {}
    for r in rows:
        pairs.setdefault(r["cluster"], []).append([x for x in r["comparison_results"].split(";") if x])
    key = lambda x: next(k for k in opposite if x.startswith(k))
    name = lambda x: x[len(key(x)) + 1 :].rsplit(",", 1)[0]
    for two in pairs.values():
        if len(two) == 2 and "Nothing to compare" not in two[0]:
            assert sorted((opposite[key(x)], name(x)) for x in two[0]) == sorted((key(x), name(x)) for x in two[1])


def test_stand_ins_are_what_their_views_say(spark):
    """Exons and junctions, made with fewer shuffles, are row by row those of the SQL views."""
    for n in ("customer", "orders", "lineitem", "part", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet").createOrReplaceTempView(n)
    for n, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(n)
    t = stand_ins(spark, "/root/testdata/sf0.001")
    want = {n: checked(spark.sql(VIEWS[n]), n) for n in ("transcript_exon", "junctions")}
    rows = {n: sorted(map(str, df.collect())) for n, df in want.items()}
    assert {n: sorted(map(str, t[n].collect())) for n in rows} == rows
    plan = t._made("junctions")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 3 and "SortAggregate" not in t._made("line1")._jdf.queryExecution().executedPlan().toString()


def test_verdicts_are_made_behind_the_last_shuffle(spark):
    """Of a cluster of many junctions, what is shuffled is a row for each kept domain, not one for each verdict."""
    n, names = 40, 30
    j = spark.createDataFrame([(k, "c", "G", f"chr1:{k}:{k}", k, k, "G") for k in range(n)], "ord bigint, cluster string, gene_raw string, junction_name string, start bigint, end bigint, gene string")
    kept = spark.createDataFrame([(k, f"D{k}", 10 + k, 1, 10 + k, "text") for k in range(names)], "ord bigint, name string, len bigint, AA_start bigint, AA_end bigint, description string")
    one = core.compared(core.held_domains(j, kept), j.select("cluster", F.lit("g").alias("gene_name")).distinct())
    rows = core.verdicts(one).collect()
    assert len(rows) == n * names and Counter(r["category"] for r in rows) == {0: names, 1: (n - 1) * names}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and plan.index("Project") < plan.index("Join")  # texts after the joins
    assert "format_string" not in plan[plan.index("Join") :]


def test_longest_of_equal_domains(spark):
    """Kept straight from the hits as from the domains of which equal ones are made one."""
    s = stages(stand_ins(spark, "/root/testdata/sf0.001"))
    want = core.longest_per_name(core.relevant_domains(s.usable, s.ranges, s.domains))
    got = core.kept_domains(s.usable, s.ranges, s.domains)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    aggregates = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert aggregates(got) < aggregates(want)


def test_empty(spark):
    t = {n: spark.createDataFrame([], SCHEMAS[n]) for n in SCHEMAS}
    assert cluster_report(t).count() == 0


def test_requested(spark):
    assert {r["cluster"] for r in requested(cluster_report(make(spark)), " G1 ,G9").collect()} == {"c1", "c2", "c3"}
    assert requested(cluster_report(make(spark)), "G9").count() == 0


def test_islands(spark):
    d = spark.createDataFrame([("P", 10, 30, 1), ("P", 25, 60, 2), ("P", 60, 70, 3), ("P", 80, 90, 4)], "protein string, AA_start long, AA_end long, position long")
    got = [(r["AA_start"], r["AA_end"], r["has_overlap"]) for r in layout.islands(d).orderBy("island").collect()]
    assert got == [(25, 60, True), (80, 90, False)]


def test_lanes(spark):
    items = spark.createDataFrame([("k", 42.5, 35.0, "abcd", 100.0), ("k", 60.0, 10.0, "abcdefghij", 100.0)], "key string, center double, width double, text string, axis_max double")
    assert [r["lane"] for r in layout.label_lanes(items).orderBy("center").collect()] == [0, 1]


def lanes_brute(items, lanes=4):
    """By the rule: a label goes to the lowest lane all of whose labels so far end left of it, else to the lane that ends first."""
    placed = []
    for center, text, width, axis in sorted(items):
        half = max(width / 4, 2.2 * len(text))
        end_of = [max((e for l, e in placed if l == k), default=-1e12) for k in range(lanes)]
        fits = [k for k in range(lanes) if end_of[k] <= center - half]
        placed.append((fits[0] if fits else min(range(lanes), key=lambda k: (end_of[k], k)), center + half + max(3.0, axis / 250)))
    return [lane for lane, _ in placed]


def test_lanes_brute(spark):
    rng = random.Random(7)
    keys = {f"k{k}": [(float(rng.randint(0, 300)), "x" * rng.randint(1, 14), float(rng.randint(8, 90)), 500.0) for _ in range(rng.randint(1, 20))] for k in range(15)}
    df = spark.createDataFrame([(k, c, w, t, a) for k, v in keys.items() for c, t, w, a in v], "key string, center double, width double, text string, axis_max double")
    got = {}
    for r in layout.label_lanes(df).collect():
        got.setdefault(r["key"], []).append((r["center"], r["text"], r["lane"]))
    for k, v in keys.items():
        assert sorted(got[k]) == sorted(zip([x[0] for x in sorted(v)], [x[1] for x in sorted(v)], lanes_brute(v), strict=True))


def test_strips(spark):
    t = make(spark)
    hits = layout.domain_segments(spark.createDataFrame([("T1", 20, 40, 1)], "tx string, AA_start long, AA_end long, position long"), layout.coding_segments(t["transcript_exon"]))
    assert [(r["segment"], r["start_aa"], r["end_aa"]) for r in hits.orderBy("segment").collect()] == [(1, 20.0, 30.0), (2, 30.0, 40.0)]
    axis = spark.createDataFrame([("T1", 200.0)], "tx string, axis_max double")
    strips = layout.domain_strips(hits, axis).orderBy("strip").collect()
    assert len(strips) == 80 and [r["segment"] for r in strips] == [1] * 40 + [2] * 40 and strips[39]["strip_height"] == pytest.approx(0.25, abs=1e-3)


def test_labels_and_numbers(spark):
    row = spark.createDataFrame([("Immunoglobulin-like", "x", None, "NaN")], "interpro string, pfam string, cdd string, smart string")
    assert row.select(scalars.domain_label(F.lit(False))).first()[0] == "Immunoglobulin*"[:14] + "*"
    n = spark.createDataFrame([(999.5,), (1234567.0,), (12345.0,), (-2000.0,), (0.5,), (100000.0,)], "n double")
    assert [r[0] for r in n.select(scalars.axis_number(F.col("n"))).collect()] == ["1000", "1.235M", "12.34K", "-2K", "0", "100K"]


def test_exon_parts(spark):
    t = make(spark)
    got = {(r["part"], r["start"], r["end"]) for r in layout.exon_parts(t["transcript_exon"], t["transcripts"]).filter("tx = 'T1'").collect()}
    assert got == {("untranslated", 50, 80), ("coding", 100, 199), ("coding", 300, 399), ("coding", 500, 590), ("right_utr", 590, 599)}


def test_sources_and_sink(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    with sqlite3.connect(path) as con:
        con.execute("create table Genes (gene_ensembl_id text, n integer, x real)")
        con.executemany("insert into Genes values (?, ?, ?)", [(f"G{k}", k, None if k == 3 else k / 2) for k in range(20)])
    spark.dataSource.register(SQLiteSource)
    df = spark.read.format("sqlite_table").option("path", path).option("table", "Genes").option("partitions", "3").load()
    assert df.count() == 20 and df.agg(F.sum("n"), F.count("x")).first()[:] == (190, 19)
    book = tmp_path / "b.xlsx"
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>%s</sheetData></worksheet>'
    cells = '<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>cluster</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>chr1:1:2</t></is></c></row>'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet % cells)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>h_junction</t></si></sst>')
    assert [tuple(r) for r in read_xlsx(spark, str(book)).collect()] == [(0, "chr1:1:2", None)]
    out = str(tmp_path / "out")
    write_single_csv(cluster_report(make(spark)).orderBy("cluster", "ord"), out)
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    assert os.path.isfile(out) and back.count() == 6 and back.columns[0] == "ord"
    with pytest.raises(ValueError, match="lacks"):
        checked(df, "genes")


def test_files_to_report(spark, tmp_path):
    """A workbook (whose first sheet isn't the one of the lowest number) and a database, by way of the readers, to the CSV."""
    t, db, book = make(spark), str(tmp_path / "a.sqlite"), tmp_path / "b.xlsx"
    with sqlite3.connect(db) as con:
        for here, there in DATABASE_TABLES.items():
            names = t[here].columns
            con.execute(f"create table {there} ({', '.join(f'{n} {dict(t[here].dtypes)[n]}' for n in names)})")
            con.executemany(f"insert into {there} values ({', '.join('?' * len(names))})", [tuple(r) for r in t[here].collect()])
        con.execute("create view Seen as select * from Genes")
    cell = lambda x: f'<c t="inlineStr"><is><t>{x}</t></is></c>'
    rows = [SHEET_COLUMNS, *[(f"chr1:{a}:{b}", "S", g, "1", c) for _, c, g, a, b in J]]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="x" sheetId="5" r:id="rId2"/><sheet name="y" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{''.join('<row>' + ''.join(map(cell, r)) + '</row>' for r in rows)}</sheetData></worksheet>")
    out = str(tmp_path / "out")
    drawn = report_of_files(spark, str(book), db, out, "G1")
    back = spark.read.option("header", True).option("escape", '"').csv(out)
    assert os.path.isfile(out) and {"a.sqlite", "b.xlsx", "out"} == {x for x in os.listdir(tmp_path) if not x.endswith(".crc")} and back.columns == ["cluster", "gene_name", "junction_name", "gene_id", "start", "end", "comparison_results", "domain_descriptions"]
    assert [r["comparison_results"] for r in back.collect()][:2] == ["Longer SH3, 21 vs 9", "Shorter SH3, 9 vs 21"]
    assert [r["idx"] for r in drawn["junction_table"].filter("cluster = 'c1'").orderBy("ord").collect()] == ["1", "2", "3"]
    assert {r["tx"] for r in drawn["transcripts"].collect()} == {"T1", "T2"} and drawn["brackets"].count() > 0
    assert spark.read.format("sqlite_table").option("path", db).option("table", "Seen").load().count() == 1
    main(["layout", "syma", "-db", db, "-o", str(tmp_path / "drawn"), "--domains-only"])
    assert set(os.listdir(tmp_path / "drawn")) == {*drawn.TABLES, "documents"}
    assert spark.read.parquet(str(tmp_path / "drawn" / "documents")).first()["svg"].startswith("<svg")


def test_gene_layout(spark):
    t = make(spark)
    drawn = gene_layout(t, "syma", per_page=2)
    assert sorted(r["title"] for r in drawn["pages"].collect()) == [f"syma - human  |  chr1:50-600  |  3 transcript(s)  (page {k}/2)" for k in (1, 2)]
    assert {r["caption"] for r in drawn["transcripts"].collect()} == {"Transcript: T1  |  Protein: P1", "Transcript: T2  |  Protein: P2", "Transcript: T3  |  Protein: N/A"}
    shapes = {(r["tx"], r["domain"]): r for r in drawn["shapes"].collect()}
    assert len(shapes) == 6 and {r["fill"] for r in shapes.values()} <= {"solid", "strips", "fallback"}
    assert [shapes["T1", k]["z"] for k in sorted(range(1, 5), key=lambda k: shapes["T1", k]["z"])] == [0, 1, 2, 3] and shapes["T1", 4]["z"] == 0
    assert all(r["width"] >= 8 for r in shapes.values())
    assert {r["text"] for r in drawn["labels"].collect()} <= {"Kinase", "SH3", "WD", "Kinase*", "SH3*", "WD*"}
    assert gene_layout(t, "SYMA", protein_only=True)["pages"].first()["title"].endswith("2 transcript(s)")
    with pytest.raises(ValueError, match="isn't in the table"):
        find_gene(t["genes"], "nobody")


def test_command_line():
    a = parser().parse_args(["layout", "PUF", "-db", "x", "--domains-only"])
    assert a.gene_name == "PUF" and a.domains_only and not a.protein_only
    assert parser().parse_args(["report", "-input", "a", "-dochap", "b"]).output_csv == "junctions.csv"


def test_stream(spark, tmp_path):
    from splicelake.streaming.junctions import read_junctions, usable_junctions

    t = make(spark)
    t["junctions"].write.parquet(str(tmp_path / "in"))
    query = usable_junctions(read_junctions(spark, str(tmp_path / "in")), stages(t).domains).writeStream.format("memory").queryName("usable").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("usable").count() == 6
