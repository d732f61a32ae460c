"""Millrace: keyed stages, monoidal joins, codecs and pipelines over Spark DataFrames."""
