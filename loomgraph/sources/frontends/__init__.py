"""Text front-ends: source text to rows of nodes, local edges and unresolved references.

A front-end is a function ``parse(path, text) -> Rows``, registered by language. ``parse_files`` runs them as one
map over file rows: every file is a task's own work, and an error in one becomes a row, not a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.exprs import language_of
from .rows import Rows, SCHEMA

REGISTRY: dict[str, Callable[[str, str], Rows]] = {}


def register(*languages: str):
    def add(f: Callable[[str, str], Rows]):
        for language in languages:
            REGISTRY[language] = f
        return f

    return add


def parse(path: str, language: str, text: str) -> Rows:
    """Rows of one file; what a parser cannot read is an error row beside what it could."""
    from . import foreign, scripts, systemverilog, vhdl  # noqa: F401  they register themselves

    rows = Rows(path, language)
    front = REGISTRY.get(language)
    if front is None:
        return rows
    try:
        return front(path, text)
    except Exception as e:
        rows.error(1, f"{type(e).__name__}: {e}")
        return rows


def parse_files(files: DataFrame) -> DataFrame:
    """Rows (SCHEMA) of the files (path, text)."""
    asked = files.select("path", "text", language_of(F.col("path")).alias("language")).where(F.col("language") != "unknown")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [r for path, text, language in batch[["path", "text", "language"]].itertuples(index=False) for r in parse(path, language, text or "").out()]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return asked.mapInPandas(run, SCHEMA)


def ir_nodes(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'node'").select("file", "ordinal", "id", "kind", "name", "qualified_name", "line", "language", "attrs")


def ir_edges(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'edge'").select("file", "ordinal", F.col("id").alias("src"), F.col("target").alias("dst"), "kind", "confidence", "attrs")


def ir_refs(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'ref'").select("file", "ordinal", F.col("id").alias("src_id"), "kind", F.col("target").alias("target_name"), "line", "language", "confidence", "attrs")


def errors(rows: DataFrame, cap: int = 20) -> DataFrame:
    """Exact number of errors by file, and the first of them."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line", "name"))), lambda e: F.concat(e["line"].cast("string"), F.lit(": "), e["name"]))
    return rows.where("row = 'error'").groupBy("file").agg(F.count("*").alias("parse_error_count"), F.slice(ordered, 1, cap).alias("parse_errors"))
