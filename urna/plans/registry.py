"""Every registered query and the SQL statement it is checked against."""

from urna.plans import (
    audit_queries, catalogue_queries, facts_queries, normalise_queries, source_queries, store_queries, verify_queries, work_queries,
)

QUERIES, ORACLE = {}, {}
for _module in (
    facts_queries, normalise_queries, audit_queries, verify_queries, source_queries, work_queries, catalogue_queries, store_queries,
):
    QUERIES.update(_module.QUERIES)
    ORACLE.update(_module.ORACLE)
