"""Explainable rule analytics over impression logs, built on Spark DataFrames."""
