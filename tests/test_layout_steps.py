"""Layout steps that carry and sort no more than they need."""

from splicelake.operators import layout
from splicelake.plans.gene_layout import gene_layout
from splicelake.sources.tables import SCHEMAS, stand_ins

SF = "/root/testdata/sf0.001"


def test_exons_are_put_in_order_by_one_sort(spark):
    rows = [("A", 1, 500, 600, 0, 0), ("A", 2, 100, 200, 0, 0), ("A", 3, 700, 800, 1, 30), ("A", 4, 1, 2, None, None), ("A", 5, 1, 2, -1, 3), ("B", 1, 9, 10, 4, 5), ("B", 2, 7, 8, None, None)]
    out = layout.exon_order(spark.createDataFrame(rows, SCHEMAS["transcript_exon"]))
    assert {(r["tx"], r["gs"]): r["position"] for r in out.collect()} == {("A", 100): 1, ("A", 500): 2, ("A", 700): 3, ("B", 7): 1, ("B", 9): 2}
    assert out._jdf.queryExecution().sparkPlan().toString().count("Window") == 2
    assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Sort [") == 1


def test_pages_make_no_domains(spark):
    drawn = gene_layout(stand_ins(spark, SF), protein_only=True, domains_only=True)
    assert drawn["pages"].count() > 0 and drawn.captioned.count() > 0
    assert not {"domains", "axis", "segments"} & set(vars(drawn))


def test_domains_of_a_layout_have_no_labels(spark):
    drawn = gene_layout(stand_ins(spark, SF), protein_only=True, domains_only=True)
    assert "pfam" not in drawn.domains.columns and drawn["labels"].count() > 0
