"""Audit agent execution traces with Spark: spans in, labelled and measured traces out."""

__version__ = "0.1.0"
