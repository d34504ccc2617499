"""All queries of the engine by name, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from . import relational, retrieval

QUERIES = retrieval.QUERIES | relational.QUERIES
SQL = retrieval.SQL | relational.SQL
