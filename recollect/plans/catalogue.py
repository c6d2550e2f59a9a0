"""All registered queries over the driver's tables, with the SQL that gives the same rows."""

from recollect.plans import audit, memory, reviews, states, streams

QUERIES: dict = {**memory.QUERIES, **audit.QUERIES, **streams.QUERIES, **reviews.QUERIES, **states.QUERIES}
ORACLE_SQL: dict = {**memory.SQL, **audit.SQL, **streams.SQL, **reviews.SQL, **states.SQL}
