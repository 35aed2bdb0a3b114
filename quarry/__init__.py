"""Relational, vector, full-text, JSON, graph and temporal analytics as Spark jobs."""
