"""All queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from tideline.llm import (
    chat_format_queries,
    decontaminate_queries,
    html_extract_queries,
    importance_queries,
    mixing_queries,
    quality_rules_queries,
    ranked_search_queries,
    secret_scan_queries,
    simhash_queries,
    suffix_dedup_queries,
    token_files_queries,
    url_filter_queries,
    weak_quality_queries,
)

MODULES = (
    html_extract_queries,
    chat_format_queries,
    url_filter_queries,
    decontaminate_queries,
    mixing_queries,
    quality_rules_queries,
    suffix_dedup_queries,
    secret_scan_queries,
    weak_quality_queries,
    simhash_queries,
    ranked_search_queries,
    token_files_queries,
    importance_queries,
)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
