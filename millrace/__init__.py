"""Millrace: text summaries and event roll-ups as plain Spark jobs."""
