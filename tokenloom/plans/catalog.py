"""Every query of the library by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import q_codecs, q_documents, q_scalar, q_search

QUERIES: dict = q_documents.QUERIES | q_scalar.QUERIES | q_search.QUERIES | q_codecs.QUERIES
SQL: dict[str, str] = q_documents.SQL | q_scalar.SQL | q_search.SQL | q_codecs.SQL
