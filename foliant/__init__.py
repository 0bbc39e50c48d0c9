"""A document-evidence analytics engine on Spark DataFrames.

functions/  column expressions: geometry, text, critical data, distances
operators/  relational operators: islands, spatial joins, multisets, sweeps
sources/    readers and writers
plans/      whole queries over the given tables, and their SQL
streaming/  the same over unbounded input
"""
