"""A change feed as a stream: relevance, quiet periods, batches with isolated errors."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import language_of

log = logging.getLogger(__name__)


def relevant(events: DataFrame, store: str | None = None, config: tuple[str, ...] = ()) -> DataFrame:
    """Events (path, ts) on source or configuration files outside the store's folder."""
    hit = (language_of(F.col("path")) != "unknown") | F.regexp_extract("path", r"([^/]*)$", 1).isin(*config)
    if store:
        hit = hit & ~F.col("path").startswith(store.rstrip("/") + "/")
    return events.where(hit)


def debounced(events: DataFrame, quiet: str, key: str = "key", late: str | None = None) -> DataFrame:
    """Batches that end when a key has been quiet for a while: (key, start, end, events, paths).

    A stream needs ``late``, how long an event may be delayed. A table is cut in two steps: see ``quieted``. The results are
    the same but for an event that comes when the quiet has just passed in full: a stream's session windows take it in, a
    table's batch has ended.
    """
    if not events.isStreaming:
        return quieted(events, quiet, key)
    rows = events.withWatermark("ts", late) if late else events
    grouped = rows.groupBy(key, F.session_window("ts", quiet).alias("w"))
    return grouped.agg(F.count("*").alias("events"), F.array_sort(F.collect_set("path")).alias("paths")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "paths")


def quieted(events: DataFrame, quiet: str, key: str = "key") -> DataFrame:
    """``debounced`` of a table. Events of a key within one span as long as the quiet are in one batch, so each span is one
    row, counted map-side, before spans are put in order; a busy key's events do not all go to one task."""
    span = F.window("ts", quiet)["start"]
    rows = events.where(F.col("ts").isNotNull()).select(F.col(key).alias("_key"), span.alias("_span"), "ts", "path")
    spans = rows.groupBy("_key", "_span").agg(F.count("*").alias("events"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    w = Window.partitionBy("_key").orderBy("_span")
    pause = F.lit(quiet).cast("interval")
    fresh = F.when(F.col("lo") < F.lag("hi").over(w) + pause, 0).otherwise(1)
    numbered = spans.withColumn("_new", fresh).withColumn("_batch", F.sum("_new").over(w))
    batches = numbered.groupBy("_key", "_batch").agg(F.min("lo").alias("start"), (F.max("hi") + pause).alias("end"), F.sum("events").alias("events"))
    named = rows.where(F.col("path").isNotNull()).select(F.col("_key").alias("_k"), F.col("_span").alias("_s"), "path").distinct()
    of = numbered.select("_key", "_span", "_batch")
    held = named.join(of, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_s") == F.col("_span"))).select("_key", "_batch", "path").distinct()
    paths = held.groupBy(F.col("_key").alias("_k"), F.col("_batch").alias("_b")).agg(F.array_sort(F.collect_list("path")).alias("paths"))
    none = F.array().cast("array<string>")
    joined = batches.join(paths, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_batch") == F.col("_b")), "left")
    return joined.select(F.col("_key").alias(key), "start", "end", "events", F.coalesce("paths", none).alias("paths"))


def each_batch(update: Callable[[DataFrame], None], failed: Callable[[int, Exception], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch whose update fails is reported, and the stream goes on."""

    def run(batch: DataFrame, number: int) -> None:
        try:
            update(batch)
        except Exception as e:
            log.exception("batch %d failed", number)
            if failed is not None:
                failed(number, e)

    return run
