"""The registered queries of the summaries, and the SQL that gives the same rows."""

from tallyforge.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
