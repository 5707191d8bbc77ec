"""Metrics of the unit graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop, materialise, together
from .components import connected_components


def percentiles(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Nearest-rank p50, p90, max and mean, the rank being rounded half to even.

    Equal values are counted first, so a group is one row per distinct value; ranks are running sums of these counts."""
    counted = rows.groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    whole = Window.partitionBy(*group)
    ranked = counted.select(*group, "v", "c", F.sum("c").over(whole.orderBy("v")).alias("upto"), F.sum("c").over(whole).alias("n"))

    def at(q: float):
        """The least value whose running count exceeds the rank."""
        return F.min(F.when(F.col("upto") > F.expr(f"cast(bround({q} * (n - 1)) as long)"), F.col("v")))

    return ranked.groupBy(*group).agg(at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("v").alias("max"), F.round(F.sum(F.col("v") * F.col("c")) / F.sum("c"), 6).alias("mean"))


def top(measured: DataFrame, n: int, order: tuple[str, ...] = ("betweenness", "degree"), name: str = "unit") -> DataFrame:
    """The first ``n`` units by falling measures, then by name."""
    return measured.orderBy(*(F.desc(c) for c in order), name).limit(max(0, n))


def compact(projected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units (unit, id) by whole numbers in the order of their names, and the links (a, b, weight) between numbers.

    Both are written once; what follows moves numbers, not names, and an order by number is one by name.
    """
    named = materialise(projected.select("parent", "target", "weight"), "links")
    units = named.select(F.explode(F.array("parent", "target")).alias("unit")).distinct()
    ids = materialise(units.repartitionByRange("unit").sortWithinPartitions("unit").select("unit", F.monotonically_increasing_id().alias("id")), "units")
    a, b = (ids.select(F.col("unit").alias(end), F.col("id").alias(name)) for end, name in (("parent", "a"), ("target", "b")))
    links = materialise(named.join(a, "parent").join(b, "target").select("a", "b", "weight"), "links")
    drop(named)
    return ids, links


def betweenness(projected: DataFrame) -> DataFrame:
    """Shortest-path betweenness (directed, unweighted, normalised), every unit being a source.

    All sources search at once (Brandes): a level has one row for each source and unit at that distance, with the number of
    shortest paths; then shares go back level by level. There are as many rows as pairs of which one reaches the other, in
    tables of the shared folder, so memory is bounded; nothing but the emptiness of a level and the number of units reaches
    the driver. Where most units reach most others, that is quadratic in the units, as the exact answer is.
    """
    ids, links = compact(projected)
    out = materialise(links.where("a <> b").select("a", "b").distinct(), "out")
    n = ids.count()
    levels = [materialise(ids.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths")), "level")]
    while True:
        found = levels[-1].join(out, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
        level = materialise(found.join(together(levels).select("s", "v"), ["s", "v"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
    shares = []
    for upper, lower in zip(reversed(levels[:-1]), reversed(levels[1:])):
        last = shares[-1] if shares else materialise(lower.withColumn("share", F.lit(0.0)), "share")
        shares = shares or [last]
        part = last.select("s", F.col("v").alias("b"), ((1 + F.col("share")) / F.col("paths")).alias("part"))
        back = upper.select("s", F.col("v").alias("a")).join(out, "a").join(part, ["s", "b"]).groupBy("s", F.col("a").alias("v")).agg(F.sum("part").alias("parts"))
        shares.append(materialise(upper.join(back, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("parts", F.lit(0.0))).alias("share")), "share"))
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    ends = ids.select("unit", "id", F.lit(0.0).alias("share"))
    if not shares:
        return ends.select("unit", F.col("share").alias("betweenness"))
    total = together(shares).where("s <> v").groupBy(F.col("v").alias("id")).agg((F.sum("share") * scale).alias("b"))
    return ends.join(total, "id", "left").select("unit", F.coalesce("b", "share").alias("betweenness"))


def articulation_points(projected: DataFrame) -> DataFrame:
    """Units without which the undirected graph falls apart: those that touch two blocks or more (Tarjan and Vishkin).

    A tree by breadth gives every unit its place in pre-order and the size of its subtree, level by level; the links beside
    the tree give the least and greatest place that a subtree is linked to. Edges of the tree that lie on a common circle
    are one component. All tables are in the shared folder; only the emptiness of a level reaches the driver.
    """
    ids, links = compact(projected)
    apart = links.where("a <> b")
    near = materialise(apart.select("a", "b").unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near")
    roots = connected_components(near, "a", "b").where("node = component")
    tree = [materialise(roots.select(F.col("node").alias("id"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth")), "tree")]
    while True:
        found = near.join(tree[-1].select(F.col("id").alias("a")), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        # A neighbour of a level is in it, above it or below it.
        level = materialise(found.join(together(tree[-2:]).select("id"), "id", "left_anti").select("id", "parent", F.lit(len(tree)).alias("depth")), "tree")
        if level.isEmpty():
            break
        tree.append(level)
    sized, below = [], None
    for level in reversed(tree):
        size = F.lit(1).cast("long")
        if below is not None:
            level, size = level.join(below.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("held")), "id", "left"), size + F.coalesce("held", F.lit(0))
        below = materialise(level.select("id", "parent", "depth", size.alias("size")), "sized")
        sized.insert(0, below)
    zero = F.lit(0).cast("long")
    placed = [materialise(sized[0].select("id", "parent", "depth", "size", zero.alias("pre"), zero.alias("up_pre"), zero.alias("up_size")), "placed")]
    before = Window.partitionBy("parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    for level in sized[1:]:
        up = placed[-1].select(F.col("id").alias("parent"), F.col("pre").alias("up_pre"), F.col("size").alias("up_size"))
        ranked = level.withColumn("gone", F.coalesce(F.sum("size").over(before), zero))
        placed.append(materialise(ranked.join(up, "parent").select("id", "parent", "depth", "size", (F.col("up_pre") + 1 + F.col("gone")).alias("pre"), "up_pre", "up_size"), "placed"))
    place = together(placed)
    a, b = (place.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("parent", "pre", "size"))) for x in "ab")
    beside = ~F.col("parent_a").eqNullSafe(F.col("b")) & ~F.col("parent_b").eqNullSafe(F.col("a"))
    far = materialise(near.join(a, "a").join(b, "b").where(beside).select("a", "b", "pre_a", "size_a", "pre_b"), "far")
    own = far.groupBy(F.col("a").alias("id")).agg(F.min("pre_b").alias("low"), F.max("pre_b").alias("high"))
    held = place.join(own, "id", "left").select(*place.columns, F.least("pre", "low").alias("low"), F.greatest("pre", "high").alias("high"))
    held = materialise(held.repartitionByRange("depth", "id").sortWithinPartitions("depth"), "held")
    spans, below = [], None
    for d in reversed(range(len(tree))):
        level = held.where(F.col("depth") == d)
        if below is not None:
            inner = below.groupBy(F.col("parent").alias("id")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
            level = level.join(inner, "id", "left").select("id", "parent", "depth", "up_pre", "up_size", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high"))
        below = materialise(level.select("id", "parent", "depth", "up_pre", "up_size", "low", "high"), "spans")
        spans.append(below)
    edge = together(spans).where("depth > 0")
    leaves = (F.col("low") < F.col("up_pre")) | (F.col("high") >= F.col("up_pre") + F.col("up_size"))
    circles = edge.where((F.col("depth") > 1) & leaves).select(F.col("parent").alias("a"), F.col("id").alias("b")).unionByName(far.where("pre_a + size_a <= pre_b").select("a", "b"))
    block = connected_components(circles, "a", "b").select(F.col("node").alias("id"), "component")
    of = edge.select("id", "parent").join(block, "id", "left").select("id", "parent", F.coalesce("component", "id").alias("block"))
    touches = of.select(F.explode(F.array("id", "parent")).alias("id"), "block").groupBy("id").agg(F.min("block").alias("one"), F.max("block").alias("other"))
    return touches.where("one < other").join(ids, "id").select("unit")


def communities(projected: DataFrame, rounds: int = 8) -> DataFrame:
    """(unit, community): weighted label propagation, the heaviest and then least label winning; a partition of all units.

    A round moves one row of numbers for each end of a link to the unit at its other end, once; earlier labels are deleted."""
    ids, links = compact(projected)
    both = materialise(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).where("a <> b").groupBy("a", "b").agg(F.sum("weight").alias("weight")), "both")
    labels = materialise(ids.select("id", F.col("id").alias("community")), "labels")
    for _ in range(rounds):
        told = both.join(labels, both.b == labels.id).select("a", "community", "weight").repartition("a")
        votes = told.groupBy("a", "community").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("a").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("m"))
        following = materialise(labels.join(best, labels.id == best.a, "left").select("id", F.least(F.coalesce("m.community", "community"), "community").alias("community")), "labels")
        drop(labels)
        labels = following
    heads = ids.select(F.col("id").alias("community"), F.col("unit").alias("head"))
    return labels.join(ids, "id").join(heads, "community").select("unit", F.col("head").alias("community"))
