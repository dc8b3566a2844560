"""All registered queries."""

from . import packet_queries, registry_queries, report_queries, score_queries, source_queries

_MODULES = [packet_queries, score_queries, registry_queries, source_queries, report_queries]

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
