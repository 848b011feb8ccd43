"""Named queries over the test tables, with the SQL that must give the same rows."""

from farpoint.plans.oracle import oracle_sql
from farpoint.plans.queries import flagship, queries

__all__ = ["flagship", "oracle_sql", "queries"]
