"""Resolution of references by name, with confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import has_glob, identifiers
from ..sources.shared import materialise
from .bounded import prefer

EXACT, UNIQUE, AMBIGUOUS, HEURISTIC = 1.0, 0.8, 0.6, 0.4


def first_occurrence(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


#: What of a reference and of a definition decides how they match; rows that agree in it are one class.
REF_CLASS, DEF_CLASS = ("kind", "target_name", "language", "file"), ("kind", "name", "language", "file", "conditional")


def matches(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """(_ref, _def, score, n): which class of definitions, of n members, a class of references resolves to, and its score.

    Ambiguous names make products of references and definitions; narrowing counts members of classes instead of forming them.
    """
    asked = refs.select(F.struct(*REF_CLASS).alias("_ref"), *REF_CLASS).distinct()
    ci = F.when(F.col("language") == "vhdl", F.lower("target_name")).otherwise(F.col("target_name"))
    asked = asked.withColumn("_lower", F.lower("target_name")).withColumn("_want", ci)
    members = definitions.groupBy(F.struct(*DEF_CLASS).alias("_def")).agg(F.count("*").alias("n"))
    defs = members.select("_def", "n", F.lower("_def.name").alias("_dlower"), F.col("_def.kind").alias("dkind"), F.col("_def.name").alias("name"), F.col("_def.language").alias("dlanguage"), F.col("_def.file").alias("dfile"), F.col("_def.conditional").alias("conditional"))
    # One join on the name without case; what the case-sensitive languages require is a residual filter.
    found = asked.join(defs, (F.col("_lower") == F.col("_dlower")) & (F.col("kind") == F.col("dkind")))
    found = found.withColumn("_same", F.col("dlanguage") == F.col("language")).where(~F.col("_same") | (F.col("_want") == F.col("name")))
    found = prefer(found, ["_ref"], F.col("_same"))
    w = Window.partitionBy("_ref")
    local = F.col("dfile") == F.col("file")
    counted = found.withColumn("_n", F.sum("n").over(w)).withColumn("_local", F.sum(F.when(local, F.col("n"))).over(w)).withColumn("_sure", F.sum(F.when(~F.col("conditional"), F.col("n"))).over(w))
    place = F.when(local, EXACT).otherwise(UNIQUE)
    kept = counted.where((F.col("_n") == 1) | F.when(F.col("_local") == 1, local).when(F.col("_sure") == 1, ~F.col("conditional")).otherwise(True))
    score = F.when(F.col("_n") == 1, place).when(F.col("_local") == 1, EXACT).when(F.col("_sure") == 1, place).otherwise(AMBIGUOUS)
    return kept.select("_ref", "_def", F.when(F.col("_same"), score).otherwise(F.least(score, F.lit(UNIQUE))).alias("score"), "n")


def resolve(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """References against definitions of the same language, then of another, then a stub.

    refs: ref_id, kind, target_name, language, file, confidence. definitions: id, kind, name, language, file,
    conditional, library. Result: ref_id, target, score. With one candidate the score is 1.0 in the same file and
    0.8 elsewhere; one local or one unconditional candidate wins over others; else all stay at 0.6. A match in
    another language is capped at 0.8. A stub keeps 1.0: its doubt is in the node, not in the edge.

    Pairs are formed by the last join alone, which is what is returned; no pair is shuffled. A class's share of them may
    be large though its rows are few, so that join is dealt to more tasks than bytes ask for.
    """
    tasks = 8 * refs.sparkSession.sparkContext.defaultParallelism
    kept = materialise(matches(refs, definitions).drop("n"), "matches")
    sides = refs.select("ref_id", "confidence", F.struct(*REF_CLASS).alias("_ref")), definitions.select(F.col("id").alias("target"), F.struct(*DEF_CLASS).alias("_def"))
    wanted = sides[0].join(kept, "_ref").select("ref_id", "_def", F.least("score", "confidence").alias("score"))
    edges = wanted.repartition(tasks, "_def").join(sides[1].repartition(tasks, "_def"), "_def").select("ref_id", "target", "score")
    missing = sides[0].join(kept.select("_ref").distinct(), "_ref", "left_anti")
    stub = F.concat(F.lit("unresolved:"), F.col("_ref.kind"), F.lit(":"), F.col("_ref.target_name"))
    return edges.unionByName(missing.select("ref_id", stub.alias("target"), F.col("confidence").alias("score")))


def resolve_counted(refs: DataFrame, definitions: DataFrame) -> DataFrame:
    """(ref_id, score, n): how many targets ``resolve`` gives a reference at a score, without forming the pairs."""
    kept = matches(refs, definitions).groupBy("_ref", "score").agg(F.sum("n").alias("n"))
    found = refs.select("ref_id", "confidence", F.struct(*REF_CLASS).alias("_ref")).join(kept, "_ref", "left")
    return found.select("ref_id", F.when(F.col("n").isNull(), F.col("confidence")).otherwise(F.least("score", "confidence")).alias("score"), F.coalesce("n", F.lit(1)).cast("long").alias("n"))


def narrow_library(candidates: DataFrame) -> DataFrame:
    """Of several candidates those of the library named (``work``: the referrer's own), or all if there are none."""
    wanted = F.when(F.col("library") == "work", F.col("own_library")).otherwise(F.col("library"))
    return prefer(candidates, ["ref_id"], F.col("dlibrary") == wanted)


def bind_positional(connections: DataFrame, ports: DataFrame) -> DataFrame:
    """Connections by place: (inst, unit, position) against a unit's ports in the order of their index."""
    ordered = ports.withColumn("position", F.row_number().over(Window.partitionBy("unit").orderBy(F.coalesce("idx", F.lit(0)), "port")) - 1)
    return connections.join(ordered, ["unit", "position"], "left").select("inst", "unit", "position", F.coalesce("port", "unit").alias("dst"), F.when(F.col("port").isNull(), AMBIGUOUS).otherwise(EXACT).alias("confidence"))


def bind_named(connections: DataFrame, ports: DataFrame) -> DataFrame:
    """Connections by name, exact before case-insensitive where either side is VHDL; a miss goes to the unit at 0.6 at most."""
    near = connections.join(ports.select("unit", "port", F.col("name").alias("pname"), F.col("language").alias("planguage")), ["unit"], "left").where(
        (F.col("pname") == F.col("name")) | (((F.col("planguage") == "vhdl") | (F.col("language") == "vhdl")) & (F.lower("pname") == F.lower("name")))
    )
    hit = prefer(near, ["inst", "name"], F.col("pname") == F.col("name")).select("inst", "unit", "name", F.col("port").alias("dst"), F.lit(EXACT).alias("confidence"))
    miss = connections.join(hit.select("inst", "name"), ["inst", "name"], "left_anti").select("inst", "unit", "name", F.col("unit").alias("dst"), F.lit(AMBIGUOUS).alias("confidence"))
    return hit.unionByName(miss)


def bind_wildcard(instances: DataFrame, ports: DataFrame) -> DataFrame:
    """``.*``: every port of the unit, or the unit itself where it has none."""
    return instances.join(ports.select("unit", "port"), "unit", "left").select("inst", "unit", F.coalesce("port", "unit").alias("dst"))


def derived_dataflow(connections: DataFrame) -> DataFrame:
    """What a connection implies: (inst, ident, kind, confidence) from (inst, direction, expr_text).

    An input reads its actual's identifiers, an output drives them, an inout does both at 0.6; several identifiers
    are 0.6 each.
    """
    kinds = F.when(F.col("direction").isin("input", "in"), F.array(F.lit("reads"))).when(F.col("direction").isin("output", "out", "buffer"), F.array(F.lit("drives"))).when(F.col("direction") == "inout", F.array(F.lit("reads"), F.lit("drives"))).otherwise(F.array().cast("array<string>"))
    lexed = connections.withColumn("_ids", identifiers(F.col("expr_text")))
    doubtful = (F.size("_ids") > 1) | (F.col("direction") == "inout")
    return lexed.select("inst", F.explode("_ids").alias("ident"), "direction", doubtful.alias("_d")).select("inst", "ident", F.explode(kinds).alias("kind"), F.when(F.col("_d"), AMBIGUOUS).otherwise(EXACT).alias("confidence"))


def constrain(queries: DataFrame, objects: DataFrame) -> DataFrame:
    """Constraint targets by exact name or glob: (query, id, confidence).

    Exact names are an equi-join. Globs are turned into expressions and held against distinct object names only;
    there are as many of them as constraints in the scripts.
    """
    exact = queries.where(~has_glob(F.col("pattern"))).join(objects, F.col("pattern") == F.col("name"))
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(F.regexp_replace("pattern", r"([.+()^$|{}\\])", r"\\$1"), r"\*", ".*"), r"\?", "."), F.lit("$"))
    globs = queries.where(has_glob(F.col("pattern"))).withColumn("regex", regex)
    named = objects.select("name").distinct().join(F.broadcast(globs), F.expr("name rlike regex")).select("query", "pattern", "name")
    matched = exact.select("query", "id", F.lit(False).alias("glob")).unionByName(named.join(objects, "name").select("query", "id", F.lit(True).alias("glob")))
    n = F.count("*").over(Window.partitionBy("query"))
    return matched.withColumn("_n", n).select("query", "id", F.when(F.col("_n") > 1, AMBIGUOUS).when(F.col("glob"), UNIQUE).otherwise(EXACT).alias("confidence"))


def choose_binding(instances: DataFrame, bindings: DataFrame) -> DataFrame:
    """What configurations bind component instances to: (inst, target, architecture), the strongest binding of each.

    instances: inst, entity, component, label, block. bindings: entity, component, label (a name, ``all`` or ``others``),
    block (null: any), target, architecture, ord. A label of its own beats ``all``, which beats ``others``; a binding for
    the block beats one for any; then the first counts.
    """
    b = bindings.select("entity", "component", F.col("label").alias("_l"), F.col("block").alias("_b"), "target", "architecture", "ord")
    fits = (F.col("label") == F.col("_l")) | F.col("_l").isin("all", "others")
    near = instances.join(b, ["entity", "component"]).where(fits & (F.col("_b").isNull() | (F.col("_b") == F.col("block"))))
    rank = F.when(F.col("_l") == "all", 1).when(F.col("_l") == "others", 2).otherwise(0)
    w = Window.partitionBy("inst").orderBy(rank, F.col("_b").isNull(), "ord", "target")
    return near.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("inst", "target", "architecture")


#: What a name in a unit can stand for, first choice first.
SCOPE_ORDER = ("port", "signal", "enum_member", "parameter")


def resolve_scoped(refs: DataFrame, scope: DataFrame) -> DataFrame:
    """Names within their unit: (ref_id, target, score).

    refs: ref_id, unit, name. scope: unit, name, child, kind, conditional. A port beats a signal, an unconditional
    declaration a conditional one. Names that stand for anything but a port or signal are dropped; undeclared names
    become signal stubs at 0.6.
    """
    rank = F.lit(len(SCOPE_ORDER))
    for i, kind in reversed(list(enumerate(SCOPE_ORDER))):
        rank = F.when(F.col("kind") == kind, F.lit(i)).otherwise(rank)
    found = refs.join(scope, ["unit", "name"], "left")
    w = Window.partitionBy("ref_id").orderBy(F.col("conditional"), rank, "child")
    best = found.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    kept = best.where(F.col("child").isNull() | F.col("kind").isin("port", "signal"))
    stub = F.concat(F.lit("unresolved:signal:"), F.col("unit"), F.lit("."), F.col("name"))
    return kept.select("ref_id", F.coalesce("child", stub).alias("target"), F.when(F.col("child").isNull(), AMBIGUOUS).otherwise(EXACT).alias("score"))


def resolve_testbench(refs: DataFrame, scope: DataFrame, units: DataFrame) -> DataFrame:
    """Testbench reads and drives against the ports and signals of the design named (refs: ref_id, top, name); misses are skipped.

    A name is met exactly first and without case else.
    """
    owned = scope.where(F.col("kind").isin("port", "signal")).join(units.select("unit", F.col("name").alias("top")), "unit")
    near = refs.join(owned.select("top", F.col("name").alias("_name"), "child"), "top").where(F.lower("_name") == F.lower("name"))
    return prefer(near, ["ref_id"], F.col("_name") == F.col("name")).select("ref_id", F.col("child").alias("target"), F.lit(AMBIGUOUS).alias("score"))


def resolve_invokes(refs: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions that an action invokes in its own file (refs: ref_id, src, file, name; actions: id, file, name); misses are skipped."""
    return refs.join(actions, ["file", "name"]).where(F.col("src") != F.col("id")).select("ref_id", F.col("id").alias("target"), F.lit(EXACT).alias("score"))


def resolve_files(refs: DataFrame, files: DataFrame) -> DataFrame:
    """File references (ref_id, path) to file nodes or stubs."""
    joined = refs.join(files.select("path", F.lit(True).alias("_known")).distinct(), "path", "left")
    return joined.select("ref_id", F.concat(F.when(F.col("_known"), "file:").otherwise("unresolved:file:"), F.col("path")).alias("target"))


def prefer_package(candidates: DataFrame) -> DataFrame:
    """Bases of a class: of each reference's candidates (ref_id, package, qualified_name) those of its own package, or all."""
    return prefer(candidates, ["ref_id"], F.startswith("qualified_name", F.concat("package", F.lit("."))))


def foreign_targets(candidates: DataFrame) -> DataFrame:
    """Foreign functions (ref_id, direction, language, is_definition): imports bind to C and C++, definitions before
    declarations, exports to (System)Verilog."""
    own = F.when(F.col("direction") == "import", F.col("language").isin("c", "cpp")).otherwise(F.col("language").isin("systemverilog", "verilog"))
    return prefer(candidates.where(own), ["ref_id"], F.col("is_definition") | (F.col("direction") != "import"))


def prefer_assertable(candidates: DataFrame) -> DataFrame:
    """Targets of assertions (ref_id, kind): properties and sequences before signals of the name."""
    return prefer(candidates, ["ref_id"], F.col("kind").isin("property", "sequence"))
