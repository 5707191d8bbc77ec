"""What the operators of this subpackage share: shared storage and native text expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import drop, materialise, shared_dir, tidy  # noqa: F401

#: White space and what it is not, as the contracts define words.
SPACES = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"


#: Rows of text that a Python worker gets at once; texts may be long, and both sides hold a batch in memory.
BATCH = 2_000


def small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, after the session's Arrow batches have been made no larger than ``BATCH`` rows."""
    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= BATCH:
        conf.set(key, str(BATCH))
    return docs


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-side table as a native relation (no RDD behind it)."""
    ddl = T.ArrayType(T._parse_datatype_string(schema))
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), ddl)).alias("r")).select("r.*")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text as an array; empty if there are none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def count_chars(text: Column, class_: str) -> Column:
    """How many characters of ``text`` a regular expression's character class holds."""
    return F.regexp_count(text, F.lit(class_))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
