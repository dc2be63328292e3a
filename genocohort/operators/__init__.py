"""Relational operators over genomic tables: DataFrames in, DataFrames out."""
