"""Relational and vector operators built from DataFrames."""
