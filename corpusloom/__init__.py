"""Spark-first analytics engine for document corpora and evidence ledgers."""
