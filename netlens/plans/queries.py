"""All queries over the driver's tables, and the same in SQL."""

from netlens.plans import content, frames, traffic

QUERIES = {**traffic.QUERIES, **content.QUERIES, **frames.QUERIES}
ORACLE_SQL = {**traffic.ORACLE_SQL, **content.ORACLE_SQL, **frames.ORACLE_SQL}
