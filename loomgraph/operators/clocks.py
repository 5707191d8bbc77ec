"""Clock domains, resets and crossings between domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bounded import of_kind
from .components import connected_components


def roots(edges: DataFrame) -> DataFrame:
    """(net, root) for nets that are aliases of others: the least id of their component."""
    return connected_components(of_kind(edges, "aliases").select("src", "dst")).select(F.col("node").alias("net"), F.col("component").alias("root"))


def rooted(uses: DataFrame, root: DataFrame, column: str = "dst") -> DataFrame:
    """``uses`` with the root of a net; nets without aliases are their own."""
    return uses.join(root, uses[column] == root.net, "left").withColumn("root", F.coalesce("root", column)).drop("net")


def clock_domains(edges: DataFrame, root: DataFrame) -> DataFrame:
    """Per domain: distinct processes, least confidence, and the distinct nets that it is known by."""
    clocked = rooted(of_kind(edges, "clocked_by"), root)
    return clocked.groupBy("root").agg(F.countDistinct("src").alias("process_count"), F.min("confidence").alias("min_confidence"), F.countDistinct("dst").alias("net_count"))


def of_processes(nodes: DataFrame, edges: DataFrame, *kinds: str) -> DataFrame:
    """Edges of some kinds whose source is a process; instances and units have none of their own."""
    return of_kind(edges, *kinds).join(nodes.where(F.col("kind") == "process").select(F.col("id").alias("src")), "src", "left_semi")


def domain_signals(edges: DataFrame, root: DataFrame) -> DataFrame:
    """Distinct signals that the processes of a domain drive."""
    clocked = rooted(of_kind(edges, "clocked_by"), root).select(F.col("src").alias("p"), F.col("root").alias("domain")).distinct()
    driven = of_kind(edges, "drives").select(F.col("src").alias("p"), "dst").distinct()
    return clocked.join(driven, "p").groupBy("domain").agg(F.countDistinct("dst").alias("signal_count"))


def reset_tree(edges: DataFrame, root: DataFrame) -> DataFrame:
    reset = rooted(of_kind(edges, "resets"), root)
    return reset.groupBy("root").agg(F.countDistinct("src").alias("process_count"), F.max("is_async").alias("is_async"), F.min("confidence").alias("min_confidence"))


def process_domain(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(p, domain, conf) of processes with one domain; those with several are left out."""
    clocked = rooted(of_kind(edges, "clocked_by"), root)
    return clocked.groupBy(F.col("src").alias("p")).agg(F.min("root").alias("domain"), F.max("root").alias("other"), F.max("confidence").alias("conf")).where("domain = other").drop("other")


def crossings(edges: DataFrame, root: DataFrame) -> DataFrame:
    """Signals driven in one domain and read in another: least confidence of the best path for each reader.

    For each signal and domain the strongest driver counts (the smallest id of equals). The signal's rows are
    reduced to one per domain before they meet its readers, so a signal with many drivers makes no product.
    """
    own = process_domain(edges, root)
    drives = of_kind(edges, "drives").join(own, F.col("src") == F.col("p")).select("dst", "domain", F.least("confidence", "conf").alias("c"), F.col("src").alias("driver"))
    best = drives.groupBy("dst", "domain").agg(F.min(F.struct((-F.col("c")).alias("nc"), "driver")).alias("b")).select(F.col("dst").alias("signal"), F.col("domain").alias("driver_domain"), (-F.col("b.nc")).alias("dc"), F.col("b.driver").alias("driver_id"))
    reads = of_kind(edges, "reads").join(own, F.col("src") == F.col("p")).groupBy(F.col("dst").alias("signal"), F.col("src").alias("reader_id"), F.col("domain").alias("reader_domain")).agg(F.max(F.least("confidence", "conf")).alias("rc"))
    both = reads.join(best, "signal").where("reader_domain <> driver_domain")
    return both.select(F.col("signal").alias("signal_id"), "driver_id", "driver_domain", "reader_id", "reader_domain", F.least("dc", "rc").alias("confidence"))


def crossing_counts(edges: DataFrame, root: DataFrame) -> DataFrame:
    return crossings(edges, root).groupBy("driver_domain", "reader_domain").agg(F.count("*").alias("n"), F.min("confidence").alias("min_confidence"), F.countDistinct("signal_id").alias("signals"))


def bridged(nodes: DataFrame, edges: DataFrame, root: DataFrame) -> DataFrame:
    """One step through combinational processes: a signal that one drives takes the domains of the signals it reads."""
    own = process_domain(edges, root).select("p", "domain")
    driven = of_kind(edges, "drives").join(own, F.col("src") == F.col("p")).select(F.col("dst").alias("s"), "domain").distinct()
    plain = nodes.where((F.col("kind") == "process") & F.col("combinational")).select(F.col("id").alias("p"))
    reads = of_kind(edges, "reads").select(F.col("src").alias("p"), F.col("dst").alias("s"))
    seen = reads.join(plain, "p", "left_semi").join(driven, "s").select("p", "domain").distinct()
    writes = of_kind(edges, "drives").select(F.col("src").alias("p"), F.col("dst").alias("out"))
    return writes.join(seen, "p").groupBy(F.col("out").alias("signal_id"), F.col("domain").alias("via_domain")).agg(F.countDistinct("p").alias("bridges"))


def alias_pairs(connects: DataFrame, nets: DataFrame) -> DataFrame:
    """(formal, actual) for every port that an instance binds to a plain net: its expression is the net's name.

    connects: inst, formal, scope, expr_text. nets: scope, id, name. Expressions of more than a name are no aliases; VHDL's
    names are stored in lower case, so an expression in other letters counts as well.
    """
    text = F.trim(F.coalesce("expr_text", F.lit("")))
    bound = connects.select("scope", "formal", F.explode(F.array_distinct(F.array(text, F.lower(text)))).alias("name")).where("name <> ''")
    return bound.join(nets.select("scope", "name", F.col("id").alias("actual")), ["scope", "name"]).select("formal", "actual").distinct()


def collapses(pairs: DataFrame, domain_roots: DataFrame) -> DataFrame:
    """(root, formal, nets): formals whose several actuals are one net only because they share the formal.

    A formal has one node however often its module is instantiated, so different actuals are merged by it. The merge is
    corroborated where formals bound to a single net, which merge nothing, join the actuals as well. Only components
    whose root is a domain's (``domain_roots``: root) count, since any data port of a leaf used twice has several actuals.
    """
    single = pairs.groupBy("formal").agg(F.count("*").alias("n"), F.min("actual").alias("actual")).where("n = 1").select("formal", "actual")
    everything = connected_components(pairs, "formal", "actual")
    sure = connected_components(single, "formal", "actual")
    apart = pairs.join(sure, F.col("actual") == F.col("node"), "left").groupBy("formal").agg(F.count("*").alias("nets"), F.countDistinct(F.coalesce("component", "actual")).alias("known")).where("nets > 1 and known > 1")
    rooted_ = apart.join(everything, F.col("formal") == F.col("node")).select(F.col("component").alias("root"), "formal", "nets")
    return rooted_.join(domain_roots.select("root").distinct(), "root", "left_semi")
