"""Joins of junctions and transcripts, and numbers, with one shuffle."""

import random

from pyspark.sql import functions as F

from splicelake.operators import core, layout
from splicelake.operators.numbering import numbered
from splicelake.plans.report import stages
from splicelake.sources.tables import stand_ins

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def spread(spark, make):
    """`make`'s value where no side is broadcast, as for large tables."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return make()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def places(spark):
    rng = random.Random(4)
    j = spark.createDataFrame([(k, "c", "G", s, s + rng.randint(-3, 900)) for k, s in enumerate(rng.sample(range(60_000), 300))], "ord long, cluster string, gene string, start long, end long")
    x = spark.createDataFrame([("G", f"t{t}", s, s + rng.randint(0, 400)) for t in range(5) for s in rng.sample(range(60_000), 40)], "gene string, tx string, gs long, ge long")
    return j, x


def test_matching_takes_no_shuffle_behind_its_join(spark):
    j, x = places(spark)
    rows = [tuple(r) for r in x.collect()]
    want = set()
    for k, c, _, s, e in j.collect():
        a, b = min(s, e), max(s, e)
        for tx in {r[1] for r in rows}:
            own = [(p, q) for _, t, p, q in rows if t == tx]
            between = any(q == a for _, q in own) and any(p == b for p, _ in own) and not any(p > a and q < b for p, q in own)
            if between or any(p < a < q or p < b < q for p, q in own):
                want.add((k, c, tx, a, b))
    got = layout.matching_junctions(j, x, 1024)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # Junctions by gene and bin, exons by transcript, transcripts by gene and bin.
    assert spread(spark, lambda: exchanges(layout.matching_junctions(j, x))) <= 3


def test_ranges_take_no_shuffle_behind_their_join(spark):
    j, x = places(spark)
    j = j.withColumn("gene_raw", F.col("gene"))
    x = x.withColumns({"exon_rank": F.lit(1), "cds_start": F.lit(1), "aa_start": F.col("gs"), "aa_end": F.col("ge")})
    assert spread(spark, lambda: exchanges(core.nonskipping_aa_ranges(j, x))) <= 3
    assert spread(spark, lambda: exchanges(core.supporting_transcripts(j, x))) <= 3
    assert spread(spark, lambda: exchanges(core.supporting_aa_ranges(j, x))) <= 3


def test_relevant_sites_are_the_relevant_domains(spark):
    s = stages(stand_ins(spark, SF))
    want = core.relevant_domains(s.usable, s.ranges, s.domains)
    assert sorted(map(str, stages(s.tables).relevant.collect())) == sorted(map(str, want.select(*s.relevant.columns).collect()))


def test_numbers_are_read_without_a_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("key"), F.col("id").alias("ord"))
    out = numbered(df, ["key"], ["ord"], "n", 16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    big = [line for line in plan.split("\n") if "Window" in line or "Aggregate" in line]
    assert all("_here" not in line or "_run" in line for line in big) and plan.count("ResolvedHint") + plan.count("strategy=broadcast") >= 1
    assert out.filter(F.col("n") != F.floor(F.col("ord") / 7) + 1).count() == 0
