"""All registered queries of the reference's operators, with their oracle SQL."""

from __future__ import annotations

from braidmark.plans import carried_queries, catalog_queries, package_queries, repair_queries, retrieval_queries, rollup_queries, stream_queries, structure_queries, verdict_queries, verification_queries, work_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (retrieval_queries, rollup_queries, structure_queries, catalog_queries, verification_queries, package_queries, work_queries, verdict_queries, stream_queries, carried_queries, repair_queries):
    QUERIES.update(_module.BOOK.queries)
    ORACLE_SQL.update(_module.BOOK.sql)
