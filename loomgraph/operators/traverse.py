"""Traversals: hierarchy, subtree, impact, closures, enclosing units, chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialise
from .bounded import near, of_kind

MAX_DEPTH = 64
#: Kinds of edges whose source depends on their target.
DIRECT = ("imports", "extends", "uses_package", "binds")


def step_edges(edges: DataFrame) -> DataFrame:
    """(parent, inst, target, confidence): a unit's instances and what they stand for."""
    holds = of_kind(edges, "declares").select(F.col("src").alias("parent"), F.col("dst").alias("inst"))
    uses = of_kind(edges, "instantiates").select(F.col("src").alias("inst"), F.col("dst").alias("target"), "confidence")
    return holds.join(uses, "inst")


def hierarchy(edges: DataFrame, top: str, max_depth: int) -> DataFrame:
    """One row per path below a unit: depth, unit, instance, confidence; a path stops where it would repeat a unit.

    Each level meets the edges of its own units only, and is all that is written.
    """
    spark = edges.sparkSession
    level = spark.range(1).select(F.lit(0).alias("depth"), F.lit(top).alias("unit"), F.lit(None).cast("string").alias("inst"), F.lit(1.0).alias("confidence"), F.array(F.lit(top)).alias("path"))
    out = level
    for d in range(1, max_depth + 1):
        steps = below(edges, level.select("unit"))
        nxt = level.join(steps, level.unit == steps.parent).where(~F.array_contains("path", F.col("target")))
        level = materialise(nxt.select(F.lit(d).alias("depth"), F.col("target").alias("unit"), steps.inst.alias("inst"), steps.confidence.alias("confidence"), F.concat("path", F.array("target")).alias("path")), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.drop("path")


def below(edges: DataFrame, units: DataFrame) -> DataFrame:
    """The steps (parent, inst, target, confidence) down from some units (one column)."""
    holds = near(of_kind(edges, "declares"), "src", units).select(F.col("src").alias("parent"), F.col("dst").alias("inst"))
    uses = of_kind(edges, "instantiates").select(F.col("src").alias("inst"), F.col("dst").alias("target"), "confidence")
    return holds.join(uses, "inst")


def dependants(edges: DataFrame, units: DataFrame) -> DataFrame:
    """(src, dst, via): who depends on some units (one column)."""
    uses = near(of_kind(edges, "instantiates"), "dst", units).select(F.col("dst").alias("src"), F.col("src").alias("inst"))
    holds = of_kind(edges, "declares").select(F.col("src").alias("dst"), F.col("dst").alias("inst"))
    direct = near(of_kind(edges, *DIRECT), "dst", units).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("kind").alias("via"))
    return uses.join(holds, "inst").select("src", "dst", F.lit("instantiates").alias("via")).unionByName(direct)


def reach(links: DataFrame | Callable[[DataFrame], DataFrame], seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Breadth-first search over ``links`` (src, dst, via) from ``seeds`` (id): (id, depth, via), seeds at depth 0.

    ``links`` may be a function that gives the links of a level's ids, so that a bounded search reads little of the
    graph, or without ``src`` what these ids are linked to. Each level is written to shared storage and met with what is known by an anti join, so lineage stays short
    and nothing but the emptiness of a level (and a few of its ids) reaches the driver.
    """
    known = materialise(seeds.select("id").distinct().select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")), "reach")
    level = known
    for d in range(1, max_depth + 1):
        own = links(level.select("id")) if callable(links) else links
        own = own.join(level.select(F.col("id").alias("src")), "src") if "src" in own.columns else own
        found = own.groupBy(F.col("dst").alias("id")).agg(F.min("via").alias("via"))
        level = materialise(found.join(known.select("id"), "id", "left_anti").select("id", F.lit(d).alias("depth"), "via"), "reach")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def impact(edges: DataFrame, seeds: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Who depends on the seeds: the unit that holds an instance on the unit instantiated, and who imports or extends."""
    return reach(lambda ids: dependants(edges, ids), seeds, max_depth).where("depth > 0")


def subtree(edges: DataFrame, top: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    seeds = edges.sparkSession.range(1).select(F.lit(top).alias("id"))
    steps = lambda ids: below(edges, ids).select(F.col("parent").alias("src"), F.col("target").alias("dst"), F.lit("instantiates").alias("via"))
    return reach(steps, seeds, max_depth)


def enclosing(parents: DataFrame, stops: DataFrame) -> DataFrame:
    """(id, unit): the nearest ancestor among ``stops`` by pointer jumping; parents: (id, parent), the least parent of each.

    A pointer that has come to a unit stays; the others double their reach each round, so 64 rounds are enough for any
    chain that ends; ids on a circle of parents are an error.
    """
    one = parents.groupBy("id").agg(F.min("parent").alias("parent"))
    at = materialise(one.join(stops.select(F.col("id").alias("u")), F.col("parent") == F.col("u"), "left").select("id", "parent", F.col("u").isNotNull().alias("done")), "climb")
    for _ in range(MAX_DEPTH):
        if at.where(~F.col("done")).isEmpty():
            return at.select("id", F.col("parent").alias("unit"))
        up = at.select(F.col("id").alias("p"), F.col("parent").alias("up"), F.col("done").alias("up_done"))
        moved = at.join(up, (at.parent == up.p) & ~at.done, "left")
        at = materialise(moved.where(F.col("done") | F.col("up").isNotNull()).select("id", F.coalesce(F.when(~F.col("done"), F.col("up")), F.col("parent")).alias("parent"), (F.col("done") | F.coalesce("up_done", F.lit(False))).alias("done")), "climb")
    raise ValueError("parents that hold each other")


def chains(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, base, hops): where each class's chain of first bases ends, by doubling."""
    first = of_kind(edges, "extends").groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("base"))
    at = materialise(first.withColumn("hops", F.lit(1)), "chain")
    for _ in range(max(1, max_depth.bit_length())):
        up = at.select(F.col("id").alias("b"), F.col("base").alias("up"), F.col("hops").alias("more"))
        at, old = materialise(at.join(up, at.base == up.b, "left").select("id", F.coalesce("up", "base").alias("base"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("up").isNotNull().alias("moved")), "chain"), at
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("id", "base", "hops")


def role(base: str = "base"):
    """The part a class plays, from the base its chain ends in; the order decides (sequencer before sequence)."""
    out = F.lit("other")
    for prefix in reversed(("uvm_test", "uvm_env", "uvm_agent", "uvm_driver", "uvm_monitor", "uvm_sequencer", "uvm_scoreboard", "uvm_subscriber", "uvm_sequence")):
        out = F.when(F.regexp_extract(base, r"([^:]*)$", 1).startswith(prefix), F.lit(prefix[4:])).otherwise(out)
    return out
