"""Splicing-to-domain analytics and text-corpus operators on Spark DataFrames."""
