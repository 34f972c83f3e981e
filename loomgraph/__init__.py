"""Capability-graph and corpus analytics expressed as Spark DataFrames."""
