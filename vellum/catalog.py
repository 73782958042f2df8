"""Every registered query, and its SQL where one can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.operators import advice, chunking, convert, diagnostics, events, expiring, geometry, glossary, latex, masking, progress, quality, relational, reports, retrieval, runs, scoring, segments, state, tables, titles

FLAGSHIP = "quality_score"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (quality, scoring, diagnostics, glossary, retrieval, events, relational, segments, masking, convert, state, latex, reports, geometry, runs, tables, expiring, progress, chunking, titles, advice):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
