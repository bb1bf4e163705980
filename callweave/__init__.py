"""Funding-opportunity analytics as declarative Spark plans."""
