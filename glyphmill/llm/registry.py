"""All queries of the subpackage and the SQL that some of them equal."""

from __future__ import annotations

from . import (
    queries_archives,
    queries_decontaminate,
    queries_language,
    queries_mixing,
    queries_rules,
    queries_simhash,
    queries_slots,
    queries_surrogates,
    queries_tokens,
    queries_toxicity,
)

_MODULES = (
    queries_slots,
    queries_language,
    queries_simhash,
    queries_decontaminate,
    queries_mixing,
    queries_archives,
    queries_toxicity,
    queries_rules,
    queries_surrogates,
    queries_tokens,
)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
