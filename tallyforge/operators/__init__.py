"""Mergeable summaries as DataFrame operators.

Each module has the production path over Spark's own aggregates where Spark ships one, and a
relational form: a summary is a few rows, building it is a grouped aggregation with a
partial step in each task, merging is a union and the same aggregation again.
"""
