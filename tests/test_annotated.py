"""The report's junctions against their genes' transcripts, in one join."""

import random

from pyspark.sql import functions as F

from splicelake.operators import core
from splicelake.plans import report as report_plans
from splicelake.plans.report import stages
from splicelake.sources.tables import SCHEMAS, stand_ins

SF = "/root/testdata/sf0.001"


def kept(df):
    return sorted(map(str, df.select("ord", F.inline("own")).collect()))


def test_one_join_keeps_what_two_did(spark):
    """In one row a gene or in several; the gene as given or without its version."""
    t = stand_ins(spark, SF)
    for options in ({}, {"normalize_gene_id": True}, {"null_name_literal": "None"}):
        s = stages(t, **options)
        domains = core.transcript_domains(t["transcripts"], t["proteins"], t["domain_event"], t["domain_type"])
        want = core.held_domains(s.usable, core.kept_domains(s.usable, s.ranges, domains, s.normalize_gene_id, s.null_name_literal))
        rows, ranges = kept(want), s.ranges.count()
        for most in (1, core.GENE_PART):
            annotation = core.gene_annotation(domains, t["transcript_exon"], s.null_name_literal, most)
            got = core.annotated_junctions(core.parse_junctions(t["junctions"]), annotation, s.normalize_gene_id, most == 1).cache()
            assert kept(got) == rows and got.agg(F.sum("n_ranges")).first()[0] == ranges
            assert sorted(map(str, got.select(*want.columns[:1], "cluster", "gene_raw", "junction_name", "start", "end").collect())) == sorted(
                map(str, want.select("ord", "cluster", "gene_raw", "junction_name", "start", "end").collect())
            )
            got.unpersist()


def test_odd_rows(spark):
    """Junctions from right to left, exons with nulls and turned round, transcripts without exons and in two genes."""
    rng = random.Random(3)
    place = lambda: rng.choice([None, *range(0, 60)])
    names = lambda: [rng.choice([None, "", "nan", "A", "B;c"]) for _ in range(6)]
    genes = ["G0", "G1", "G1.2"]
    tx = [(f"T{k}", rng.choice(genes), f"P{k % 7}", 1, 9, 1, 9, None) for k in range(14)] + [("T0", "G1", "P0", 1, 9, 1, 9, None), ("T0", "G1.2", "P0", 1, 9, 1, 9, None)]
    rows = {
        "genes": [("G0", "S", "h", "1", "+")], "transcripts": tx, "proteins": [(r[0], r[2]) for r in tx[:14]],
        "transcript_exon": [(f"T{rng.randrange(12)}", k, place(), place(), rng.choice([None, 0, 3, 30]), place()) for k in range(60)],
        "domain_event": [(f"P{rng.randrange(7)}", rng.randrange(6), place(), place()) for _ in range(60)],
        "domain_type": [(k, *names(), rng.choice([None, "d;e"])) for k in range(6)],
        "junctions": [(k, f"c{rng.randrange(5)}", rng.choice([*genes, "G0.1", "G9"]), f"1:{rng.randrange(60)}:{rng.randrange(60)}") for k in range(80)],
    }
    t = {n: spark.createDataFrame(rows[n], SCHEMAS[n]) for n in SCHEMAS}
    s = stages(t)
    want = core.held_domains(s.usable, core.kept_domains(s.usable, s.ranges, s.domains))
    assert len(kept(want)) > 20 and kept(s.held) == kept(want) and s.held.count() == s.usable.count()


def test_a_report_writes_two_steps(spark, monkeypatch):
    """Neither domains nor usable junctions are written by themselves; verdicts are written as the report's texts."""
    names, was = [], report_plans.stored
    monkeypatch.setattr(report_plans, "stored", lambda df, name: names.append(name) or was(df, name))
    s = stages(stand_ins(spark, SF))
    assert s.report.count() > 0 and names == ["kept", "report"]
    assert s.report.columns[:1] == ["ord"] and s.found.count() == s.counts["found"]


def test_a_hot_gene_is_dealt_over_tasks(spark, monkeypatch):
    t = stand_ins(spark, SF)
    want = kept(stages(t).held)
    monkeypatch.setattr(core, "HOT", 20)
    dealt, was = [], core.annotated_junctions
    monkeypatch.setattr(core, "annotated_junctions", lambda *a: dealt.append(a[-1]) or was(*a))
    assert kept(stages(t).held) == want and max(dealt[0].values()) > 1
