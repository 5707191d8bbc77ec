"""The six lint checks, and waivers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import glob_regex, normal_space, stripped
from .bounded import of_kind, top_modules

CHECKS = ("unconnected-port", "open-port", "undriven-signal", "unread-signal", "dead-module", "redundant-override")


def finding(rows: DataFrame, check: str, confidence: float = 1.0) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.col("id").alias("node_id"), "name", "file", "line", F.lit(confidence).alias("confidence"))


def unconnected_port(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ports that an instance with one target and at least one connection leaves out.

    All that is known of an instance (targets, connected ports, where it stands) is dealt by instance once and is one row then,
    which meets the ports of its unit as one row."""
    text = F.lit(None).cast("string")
    site = F.struct("file", "line")
    uses = of_kind(edges, "instantiates").select(F.col("src").alias("inst"), F.col("dst").alias("unit"), text.alias("port"), F.lit(None).alias("site"))
    wired = of_kind(edges, "connects").select(F.col("src").alias("inst"), text.alias("unit"), F.col("dst").alias("port"), F.lit(None).alias("site"))
    sites = nodes.where(F.col("kind") == "instance").select(F.col("id").alias("inst"), text.alias("unit"), text.alias("port"), site.alias("site"))
    every = sites.unionByName(uses).unionByName(wired).repartition("inst").groupBy("inst").agg(F.count("unit").alias("n"), F.min("unit").alias("unit"), F.collect_set("port").alias("wired"), F.collect_list("site").alias("sites"))
    some = every.where((F.col("n") == 1) & (F.size("wired") > 0) & (F.size("sites") > 0)).select("inst", "unit", "wired", "sites")
    ports = nodes.where(F.col("kind") == "port").select(F.col("id").alias("port"), F.col("name").alias("port_name"))
    holds = of_kind(edges, "declares").select(F.col("src").alias("unit"), F.col("dst").alias("port")).join(ports, "port").groupBy("unit").agg(F.collect_list(F.struct("port", "port_name")).alias("held"))
    left = F.filter("held", lambda p: ~F.array_contains(F.col("wired"), p["port"]))
    missing = some.join(holds, "unit").select(F.col("inst").alias("id"), "sites", F.explode(left).alias("p")).select("id", F.col("p.port_name").alias("name"), F.explode("sites").alias("site"))
    return finding(missing.select("id", "name", "site.file", "site.line"), "unconnected-port")


def open_port(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    text = F.lower(stripped(F.coalesce("expr_text", F.lit(""))))
    empty = of_kind(edges, "connects").where(text.isin("", "open")).select("src", "dst")
    ports = nodes.where(F.col("kind") == "port").select(F.col("id").alias("dst"), F.col("name").alias("port_name"))
    sites = nodes.where(F.col("kind") == "instance").select("id", "file", "line")
    return finding(empty.join(ports, "dst").join(sites, F.col("src") == F.col("id")).select("id", F.col("port_name").alias("name"), "file", "line"), "open-port")


def undriven_signal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    driven = of_kind(edges, "drives").select("dst").distinct()
    able = (F.col("kind") == "signal") | ((F.col("kind") == "port") & F.col("direction").isin("output", "out", "buffer"))
    return finding(nodes.where(able & ~F.col("unresolved")).join(driven, F.col("id") == F.col("dst"), "left_anti"), "undriven-signal")


def unread_signal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    read = of_kind(edges, "reads", "asserts_on", "covers").select("dst").distinct()
    return finding(nodes.where((F.col("kind") == "signal") & ~F.col("unresolved")).join(read, F.col("id") == F.col("dst"), "left_anti"), "unread-signal")


def dead_module(nodes: DataFrame, edges: DataFrame, tops: tuple[str, ...] = ()) -> DataFrame:
    dead = top_modules(nodes, edges).where(~F.col("name").isin(*tops)) if tops else top_modules(nodes, edges)
    lines = nodes.where(F.col("kind") == "module").select("id", "line")
    return finding(dead.join(lines, "id"), "dead-module", 0.4)


def redundant_override(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    defaults = nodes.where((F.col("kind") == "parameter") & F.col("default_value").isNotNull()).select(F.col("id").alias("dst"), F.col("name").alias("parameter"), "default_value")
    same = of_kind(edges, "parameterizes").join(defaults, "dst").where(normal_space(F.col("value_text")) == normal_space(F.col("default_value")))
    sites = nodes.where(F.col("kind") == "instance").select("id", "file", "line")
    return finding(same.join(sites, same.src == sites.id).select("id", F.col("parameter").alias("name"), "file", "line"), "redundant-override")


REGISTRY = {"unconnected-port": unconnected_port, "open-port": open_port, "undriven-signal": undriven_signal, "unread-signal": unread_signal, "dead-module": dead_module, "redundant-override": redundant_override}


def run(nodes: DataFrame, edges: DataFrame, checks: tuple[str, ...] = CHECKS, tops: tuple[str, ...] = ()) -> DataFrame:
    unknown = [c for c in checks if c not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown checks: {', '.join(unknown)}; there are {', '.join(CHECKS)}")
    out = None
    for c in dict.fromkeys(checks):
        part = dead_module(nodes, edges, tops) if c == "dead-module" else REGISTRY[c](nodes, edges)
        out = part if out is None else out.unionByName(part)
    return out


def waive(findings: DataFrame, waivers: list[dict]) -> DataFrame:
    """Adds ``waived_by``: the number of the first waiver whose check, name, file and line all agree.

    Waivers are few and written by hand, so each is a condition of one projection.
    """
    by = F.lit(None).cast("int")
    for i, w in reversed(list(enumerate(waivers))):
        hit = F.lit(True)
        if w.get("check"):
            hit = hit & (F.col("check") == w["check"])
        for key in ("name", "file"):
            if w.get(key):
                hit = hit & F.col(key).rlike(glob_regex(w[key]))
        if w.get("line") is not None:
            hit = hit & (F.col("line") == w["line"])
        by = F.when(hit, F.lit(i)).otherwise(by)
    return findings.withColumn("waived_by", by)


def unused_waivers(waived: DataFrame, waivers: list[dict], checks: tuple[str, ...] = CHECKS) -> list[int]:
    """Waivers of selected checks that no finding matched first."""
    used = {r["waived_by"] for r in waived.where(F.col("waived_by").isNotNull()).select("waived_by").distinct().collect()}
    return [i for i, w in enumerate(waivers) if i not in used and (not w.get("check") or w["check"] in checks)]
