"""All queries of the engine by name, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import changes, design, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**design.QUERIES, **changes.QUERIES, **texts.QUERIES}
ORACLE_SQL: dict[str, str] = {**design.ORACLE_SQL, **changes.ORACLE_SQL, **texts.ORACLE_SQL}
