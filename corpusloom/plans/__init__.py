"""Whole pipelines composed from operators."""
