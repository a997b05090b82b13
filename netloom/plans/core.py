"""All named queries of the library's own operators, and their SQL."""

from netloom.plans import stateful, traffic, views

QUERIES = {**views.QUERIES, **traffic.QUERIES, **stateful.QUERIES}
ORACLE_SQL = {**views.ORACLE_SQL, **traffic.ORACLE_SQL, **stateful.ORACLE_SQL}
