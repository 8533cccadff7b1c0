"""The queries of this subpackage and their DuckDB SQL, by name."""

from __future__ import annotations

from . import decontamination, embedding_dedup, licenses, lm_scoring, mixing, ngram_join, quality, secrets, sharding, suffix_dedup, toxicity, vector_codes, whitening

MODULES = (lm_scoring, quality, decontamination, ngram_join, embedding_dedup, licenses, mixing, suffix_dedup, toxicity, sharding, whitening, secrets, vector_codes)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
