"""A facade over a stored graph: one method for each answer, each returning a frame; look-ups that must name something raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import bounded, clocks, lint, metrics, summaries, traverse
from .sources import store


class GraphQuery:
    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges
        self._roots: DataFrame | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> GraphQuery:
        nodes, edges, _ = store.load(spark, root)
        return cls(nodes, edges)

    @property
    def roots(self) -> DataFrame:
        if self._roots is None:
            self._roots = clocks.roots(self.edges)
        return self._roots

    def unit(self, name: str) -> str:
        """The id of the unit named (the least of several)."""
        r = self.nodes.where((F.col("kind") == "module") & bounded.name_equals(F.col("name"), F.col("language"), name)).agg(F.min("id").alias("id")).first()
        if r["id"] is None:
            raise ValueError(f"no unit is named {name}")
        return r["id"]

    def search_nodes(self, pattern: str, kinds: tuple[str, ...] = (), file: str | None = None) -> DataFrame:
        return bounded.search(self.nodes, pattern, kinds, file)

    def find_module(self, *names: str) -> DataFrame:
        return bounded.find_module(self.nodes, self.edges, list(names))

    def top_modules(self) -> DataFrame:
        return bounded.top_modules(self.nodes, self.edges)

    def modules(self) -> DataFrame:
        return bounded.modules(self.nodes, self.edges)

    def hierarchy(self, top: str, max_depth: int = traverse.MAX_DEPTH) -> DataFrame:
        return traverse.hierarchy(self.edges, self.unit(top), max_depth)

    def who_instantiates(self, name: str) -> DataFrame:
        return bounded.who_instantiates(self.nodes, self.edges, name)

    def port_map(self, name: str) -> DataFrame:
        self.unit(name)
        return bounded.port_map(self.nodes, self.edges, name)

    def bindings(self, instance: str) -> DataFrame:
        return bounded.bindings(self.nodes, self.edges, instance)

    def impact(self, target: str, max_depth: int = traverse.MAX_DEPTH) -> DataFrame:
        seeds = self.nodes.where((F.col("file") == target) | F.col("file").endswith("/" + target) | (F.col("name") == target)).where(F.col("kind") == "module").select("id")
        if seeds.isEmpty():
            raise ValueError(f"nothing is named {target}")
        return traverse.impact(self.edges, seeds, max_depth)

    def clock_domains(self) -> DataFrame:
        return clocks.clock_domains(self.edges, self.roots)

    def crossings(self) -> DataFrame:
        return clocks.crossings(self.edges, self.roots)

    def reset_tree(self) -> DataFrame:
        return clocks.reset_tree(self.edges, self.roots)

    def signal_drivers(self, name: str) -> DataFrame:
        return bounded.signal_sites(self.nodes, self.edges, "drives", name)

    def signal_readers(self, name: str) -> DataFrame:
        return bounded.signal_sites(self.nodes, self.edges, "reads", name)

    def uvm_topology(self) -> DataFrame:
        return traverse.chains(self.edges).withColumn("role", traverse.role())

    def unresolved(self) -> DataFrame:
        return bounded.unresolved(self.nodes, self.edges)

    def lint(self, checks: tuple[str, ...] = lint.CHECKS, waivers: list[dict] | None = None, tops: tuple[str, ...] = ()) -> DataFrame:
        found = lint.run(self.nodes, self.edges, checks, tops)
        return lint.waive(found, waivers) if waivers else found

    def fan(self) -> DataFrame:
        return bounded.fan(bounded.projection(self.nodes, self.edges))

    def betweenness(self) -> DataFrame:
        return metrics.betweenness(bounded.projection(self.nodes, self.edges))

    def communities(self) -> DataFrame:
        return metrics.communities(bounded.projection(self.nodes, self.edges))

    def review(self) -> DataFrame:
        return summaries.review(self.nodes, self.edges)
