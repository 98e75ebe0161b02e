"""What goes to the driver."""

from splicelake.plans.gene_layout import gene_layout
from splicelake.plans.page_documents import page_documents
from splicelake.sources.tables import stand_ins

SF = "/root/testdata/sf0.001"


def test_no_table_of_all_genes_is_broadcast(spark):
    """Files of few bytes may hold many rows: of transcripts' rows 12 MB came to the driver for each join at sf0.1."""
    drawn = gene_layout(stand_ins(spark, SF), protein_only=True, domains_only=True)
    made = {"documents": page_documents(drawn), **{name: drawn[name] for name in drawn}}
    for name, df in made.items():
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString(), name
    assert made["documents"].count() == drawn["pages"].count()
