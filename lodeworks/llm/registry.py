"""The queries of this package's operators, with SQL for those that SQL can express."""

from __future__ import annotations

from lodeworks.llm import bpe, decontaminate, hard_negatives, html, langid, language_model, licences, near_duplicates, personal_data, quality, sharding, similar_vectors, vector_codes

MODULES = (decontaminate, sharding, html, langid, similar_vectors, quality, near_duplicates, language_model, licences, bpe, hard_negatives, vector_codes, personal_data)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in getattr(m, "ORACLES", {}).items()}
