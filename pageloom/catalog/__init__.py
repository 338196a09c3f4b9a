"""Every query of the repository with its DuckDB counterpart."""

from pageloom.catalog import hosts, jobs, pages, texts, watching

_PARTS = [texts, pages, jobs, hosts, watching]

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
