"""Checks machine-extracted business documents with Spark DataFrames."""
