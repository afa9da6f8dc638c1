"""All registered queries but those of the training-data subpackage."""

from __future__ import annotations

from quirespark.plans import clause_queries, document_queries, form_queries, group_queries, layout_queries, page_queries, rule_queries, scalars, sink_queries, structure_queries

MODULES = (scalars, page_queries, layout_queries, rule_queries, sink_queries, clause_queries, form_queries, document_queries, structure_queries, group_queries)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
