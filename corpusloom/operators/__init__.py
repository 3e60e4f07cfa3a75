"""Relational and text operators over DataFrames."""
