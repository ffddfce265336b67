"""Collaboration-graph analytics expressed as Spark DataFrame operators."""
