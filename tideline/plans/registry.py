"""All queries outside the training-data subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from tideline.plans import cohort_queries, curve_queries, generation_queries, rule_queries, score_queries, stat_queries, surface_queries

MODULES = (score_queries, curve_queries, cohort_queries, rule_queries, stat_queries, generation_queries, surface_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
