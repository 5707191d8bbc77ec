"""Whole-design reports beside clocks and lint: power, test coverage, constraints on crossings, health, locality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bounded import confidence_distribution, missing_targets, of_kind, top_modules
from .traverse import reach, step_edges

#: Fixed pattern: names of testbench tops.
TESTBENCH = r"(?i)^tb_|_tb$|_testbench$|^test_"
HEURISTIC = 0.4


def power_domains(domains: DataFrame, edges: DataFrame) -> DataFrame:
    """Per domain (id, name, strategies, supply): resolved elements in order, tokens left over, least confidence, isolation.

    domains: id, name, elements (array), strategies (array of kind and name), supply.
    """
    tokens = domains.select("id", F.explode_outer("elements").alias("token"))
    found = of_kind(edges, "constrains").groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("resolved"), F.min("confidence").alias("min_confidence"), F.collect_set("expr_text").alias("asked"))
    left = tokens.join(found, tokens.id == found.src, "left").where(F.col("token").isNotNull() & ~F.coalesce(F.array_contains("asked", F.col("token")), F.lit(False)))
    missing = left.groupBy("id").agg(F.array_sort(F.collect_list("token")).alias("unresolved_elements"))
    empty = F.array().cast("array<string>")
    return (
        domains.join(found.drop("asked"), domains.id == found.src, "left")
        .join(missing, "id", "left")
        .select("name", F.coalesce("resolved", empty).alias("elements"), F.coalesce("unresolved_elements", empty).alias("unresolved_elements"), F.transform("strategies", lambda s: F.concat(s["kind"], F.lit(":"), s["name"])).alias("strategies"), "supply", F.coalesce("min_confidence", F.lit(1.0)).alias("min_confidence"), F.exists("strategies", lambda s: s["kind"] == "isolation").alias("isolated"))
    )


def derive_test_covers(nodes: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """(test_id, dut_id, confidence): testbench tops by name with the units they instantiate, and every test class with all of those.

    tests: id of test classes. Tests and benches are written by hand, so their product is small by nature; it is
    formed as an equi-join on a constant key only where both sides are non-empty.
    """
    benches = top_modules(nodes, edges).where(F.col("name").rlike(TESTBENCH)).select(F.col("id").alias("test_id"))
    known = nodes.where(~F.col("unresolved")).select("id")
    duts = step_edges(edges).join(benches, F.col("parent") == F.col("test_id")).join(known, F.col("target") == F.col("id"), "left_semi").select("test_id", F.col("target").alias("dut_id")).distinct()
    by_class = tests.select(F.col("id").alias("test_id"), F.lit(1).alias("k")).join(duts.select("dut_id", F.lit(1).alias("k")).distinct(), "k").drop("k")
    return duts.unionByName(by_class).distinct().withColumn("confidence", F.lit(HEURISTIC))


def safe_pairs(constraints: DataFrame) -> DataFrame:
    """Unordered pairs (a, b) of clocks that asynchronous groups declare apart: constraints (groups: array of arrays)."""

    def against(x: Column, later: Column) -> Column:
        return F.flatten(F.transform(later, lambda y: F.flatten(F.transform(x, lambda a: F.transform(y, lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))))))

    n = F.size("groups")
    pairs = F.flatten(F.transform("groups", lambda x, i: against(x, F.slice("groups", i + 2, F.greatest(n, F.lit(1))))))
    return constraints.where("asynchronous").select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()


def mark_safe(crossings: DataFrame, pairs: DataFrame, false_paths: DataFrame) -> DataFrame:
    """Crossings with ``declared_safe``: by unordered group pairs, or by directed false paths (driver to reader)."""
    x = crossings.withColumn("a", F.least("driver_domain", "reader_domain")).withColumn("b", F.greatest("driver_domain", "reader_domain"))
    y = x.join(pairs.withColumn("by_group", F.lit(True)), ["a", "b"], "left").drop("a", "b")
    z = y.join(false_paths.select(F.col("from").alias("driver_domain"), F.col("to").alias("reader_domain"), F.lit(True).alias("by_path")).distinct(), ["driver_domain", "reader_domain"], "left")
    return z.withColumn("declared_safe", F.coalesce("by_group", F.lit(False)) | F.coalesce("by_path", F.lit(False))).drop("by_group", "by_path")


def promote_clock_evidence(edges: DataFrame, backed: DataFrame) -> DataFrame:
    """Clock edges on nets that a constraint declares as a clock (backed: net) are certain."""
    marked = edges.join(backed.select(F.col("net").alias("dst"), F.lit(True).alias("_backed")).distinct(), "dst", "left")
    sure = (F.col("kind") == "clocked_by") & F.coalesce("_backed", F.lit(False)) & (F.col("confidence") < 1.0)
    return marked.withColumn("evidence", F.when(sure, "constraint")).withColumn("confidence", F.when(sure, 1.0).otherwise(F.col("confidence"))).drop("_backed")


def dirty_closure(includes: DataFrame, defines: DataFrame, uses: DataFrame, seeds: DataFrame) -> DataFrame:
    """Files that a change reaches: (path, depth, reason) by who includes a file, and who uses a macro that it defines.

    includes: file, target. defines: file, macro. uses: file, macro.
    """
    by_include = includes.select(F.col("target").alias("src"), F.col("file").alias("dst"), F.concat(F.lit("includes "), "target").alias("via"))

    def reached(ids: DataFrame) -> DataFrame:
        """A level's macros stand between its files and the users: no file that defines a macro meets each that uses it."""
        level = ids.select(F.col("id").alias("src"))
        macros = defines.select(F.col("file").alias("src"), "macro").join(level, "src", "left_semi").select("macro").distinct()
        users = uses.join(macros, "macro").select(F.col("file").alias("dst"), F.concat(F.lit("uses macro "), "macro").alias("via"))
        return by_include.join(level, "src").select("dst", "via").unionByName(users)

    return reach(reached, seeds.select(F.col("path").alias("id"))).select(F.col("id").alias("path"), "depth", F.col("via").alias("reason"))


def corpus_health(files: DataFrame) -> DataFrame:
    """One row of counts over files (language, skipped_reason, parse_error_count)."""
    return files.agg(
        F.count_if(F.col("skipped_reason").isNull()).alias("parsed"), F.count_if(F.col("skipped_reason").isNotNull()).alias("skipped"),
        F.countDistinct("language").alias("languages"), F.coalesce(F.sum("parse_error_count"), F.lit(0)).alias("errors"), F.count_if(F.col("parse_error_count") > 0).alias("files_with_errors"),
    )


def review(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A digest of counts (section, key, n) that names nothing of the design."""
    parts = [nodes.groupBy(F.lit("nodes").alias("section"), F.col("kind").alias("key")).agg(F.count("*").alias("n")), edges.groupBy(F.lit("edges").alias("section"), F.col("kind").alias("key")).agg(F.count("*").alias("n")), confidence_distribution(edges).select(F.lit("confidence").alias("section"), F.col("confidence").alias("key"), "n")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(part / whole, 6))


def reconcile(heuristic: DataFrame, elaborated: DataFrame) -> DataFrame:
    """Discrepancies of elaborated instances (module, instance, target, n) with the graph's (module, instance, target)."""
    h = heuristic.groupBy("module", "instance").agg(F.array_sort(F.collect_set("target")).alias("seen"))
    j = elaborated.join(h, ["module", "instance"], "left")
    kind = F.when(F.col("seen").isNull(), "missing_instance").when(~F.array_contains("seen", F.col("target")), "wrong_target").when(F.col("n") > 1, "instance_count")
    return j.select("module", "instance", kind.alias("kind"), F.array_join("seen", ",").alias("heuristic"), F.concat_ws(" x", "target", F.when(F.col("n") > 1, F.col("n").cast("string"))).alias("elaborated")).where(F.col("kind").isNotNull())


def prune_paths(paths: DataFrame, max_nodes: int) -> tuple[DataFrame, int]:
    """The first rows of a path table in breadth-first order, and how many were left out."""
    total = paths.count()
    return paths.orderBy("depth", "inst", "unit").limit(max(1, max_nodes)), max(0, total - max(1, max_nodes))


def locality(refs: DataFrame, closures: DataFrame) -> DataFrame:
    """Per edited file: distinct references that its closure resolves anew (refs: file, src, kind; closures: edit, file)."""
    return closures.join(refs, "file").groupBy("edit").agg(F.countDistinct("file", "src", "kind").alias("reresolved"))


#: Rows that a report shows of each list at most (fixed values); counts beside them are of all rows.
CAPS = {"crossings": 50, "suppressed": 50, "power": 50, "collapses": 20, "instances": 20, "errors": 20, "constraints": 32}


def capped(rows: DataFrame, what: str, *order) -> tuple[int, DataFrame]:
    """How many rows there are, and those that a report shows."""
    return rows.count(), rows.orderBy(*order).limit(CAPS[what])


def status(files: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row on a stored graph: files parsed and skipped, parse errors, nodes, edges, unresolved targets."""
    by_file = files.agg(F.count_if(F.col("skipped_reason").isNull()).alias("parsed"), F.count_if(F.col("skipped_reason").isNotNull()).alias("skipped"), F.coalesce(F.sum("parse_error_count"), F.lit(0)).alias("errors"))
    counts = nodes.agg(F.count("*").alias("nodes")), edges.agg(F.count("*").alias("edges")), missing_targets(nodes, edges).agg(F.count("*").alias("unresolved"))
    out = by_file.withColumn("k", F.lit(1))
    for c in counts:
        out = out.join(c.withColumn("k", F.lit(1)), "k")
    return out.drop("k")


def test_report(nodes: DataFrame, covers: DataFrame) -> DataFrame:
    """(test, dut, confidence) by names, from test_covers (test_id, dut_id, confidence)."""
    named = lambda c, n: nodes.select(F.col("id").alias(c), F.col("name").alias(n))
    return covers.join(named("test_id", "test"), "test_id").join(named("dut_id", "dut"), "dut_id").select("test", "dut", "confidence").orderBy("test", "dut")
