"""Folio: files in, retrieval-ready chunks out, as PySpark DataFrames."""
