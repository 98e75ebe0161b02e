"""python -m splicelake report -input junctions.xlsx -dochap annotation.sqlite [-output_csv out] [-gene_ids G1,G2]
python -m splicelake layout GENE -db annotation.sqlite [-o folder] [--protein-only] [--domains-only]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.gene_layout import gene_layout
from .plans.page_documents import page_documents
from .plans.report import report_of_files
from .sources.files import read_database
from .sources.tables import SCHEMAS, checked

# The options of the command lines.
REPORT_OPTIONS = {"-input": {"required": True}, "-dochap": {"required": True}, "-output_csv": {"default": "junctions.csv"}, "-biomart_domains": {"type": bool, "default": False}, "-gene_ids": {}}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="splicelake")
    sub = top.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report")
    for name, how in REPORT_OPTIONS.items():  # -biomart_domains is accepted and has no effect
        r.add_argument(name, **how)
    v = sub.add_parser("layout")
    v.add_argument("gene_name")
    v.add_argument("-db", "--database", required=True)
    v.add_argument("-o", "--output")
    v.add_argument("--protein-only", action="store_true")
    v.add_argument("--domains-only", action="store_true")
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("splicelake").getOrCreate()
    if a.command == "report":
        out, tables = f"{a.output_csv}.layout", report_of_files(spark, a.input, a.dochap, a.output_csv, a.gene_ids) or {}
    else:
        found = {n: checked(df, n) for n, df in read_database(spark, a.database).items() if n in SCHEMAS}
        out, tables = a.output or f"{a.gene_name}_visualization", gene_layout(found, a.gene_name, a.protein_only, a.domains_only)
    documents = {"documents": page_documents(tables)} if tables else {}
    for name, df in {**tables, **documents}.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


if __name__ == "__main__":
    main()
