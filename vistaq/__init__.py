"""Hybrid retrieval over media libraries and document collections, as Spark jobs."""
