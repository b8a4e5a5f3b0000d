"""Dependency-graph analytics on Spark."""
