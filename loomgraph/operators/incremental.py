"""Snapshots, deltas, merges and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, content_hash): added, removed or changed."""
    o, n = old.select("path", F.col("content_hash").alias("a")), new.select("path", F.col("content_hash").alias("b"))
    joined = o.withColumn("in_old", F.lit(True)).join(n.withColumn("in_new", F.lit(True)), "path", "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return joined.select("path", change.alias("change")).where(F.col("change").isNotNull())


def merge_sources(parts: list[DataFrame], policy: str = "error") -> DataFrame:
    """Union of (path, content_hash, ...) tables. Equal contents are one; of others, ``first`` or ``last`` wins or it is an error."""
    rows = None
    for i, p in enumerate(parts):
        own = p.withColumn("_source", F.lit(i))
        rows = own if rows is None else rows.unionByName(own)
    if policy == "error":
        bad = rows.groupBy("path").agg(F.min("content_hash").alias("a"), F.max("content_hash").alias("b")).where("a <> b").limit(5).collect()
        if bad:
            raise ValueError("conflicting contents of " + ", ".join(r["path"] for r in bad))
    order = F.desc("_source") if policy == "last" else F.asc("_source")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(order, "content_hash"))).where("_n = 1").drop("_n", "_source")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either multiset that the other lacks, with the side they come from."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def changed_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources whose group of edges differs between two multisets: what a scoped write has to replace.

    Rows of both move once, dealt by source and with a sign each, and are only then counted: rows are nearly all distinct, so a
    table of them before the shuffle would take memory and save nothing."""
    cols = old.columns
    signed = old.withColumn("n", F.lit(1)).unionByName(new.withColumn("n", F.lit(-1)))
    return signed.repartition("src").groupBy(*cols).agg(F.sum("n").alias("n")).where("n <> 0").select("src").distinct()


def affected_refs(refs: DataFrame, changed_names: DataFrame) -> DataFrame:
    """References whose target's name and kind are among the definitions that changed."""
    return refs.join(changed_names.select("target_name", "kind").distinct(), ["target_name", "kind"], "left_semi")


def relink(refs: DataFrame, definitions: DataFrame, old_edges: DataFrame, dirty: DataFrame, changed_names: DataFrame, resolver) -> DataFrame:
    """Edges after a change, equal to a full rebuild: references of dirty files and those a change affects are resolved anew."""
    again = refs.join(dirty.select("file"), "file", "left_semi").unionByName(affected_refs(refs, changed_names)).dropDuplicates(["ref_id"])
    untouched = old_edges.join(again.select("ref_id"), "ref_id", "left_anti").join(refs.select("ref_id"), "ref_id", "left_semi")
    return untouched.unionByName(resolver(again, definitions))


def suffix_matches(added: DataFrame, missing: DataFrame) -> DataFrame:
    """Include texts that an added path equals or ends with after a slash, as an equi-join on every suffix of the path."""
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    return added.select("path", F.explode(suffixes).alias("text")).join(missing, "text").select("path", "text").distinct()


def anchored_stubs(stubs: DataFrame, referenced: DataFrame, declares: DataFrame, rounds: int = 32) -> DataFrame:
    """Stubs that something refers to, or that such a stub declares, however deep."""
    from ..sources.shared import materialise
    from .traverse import reach

    seeds = stubs.join(referenced.select("id").distinct(), "id", "left_semi")
    inner = declares.join(stubs.select(F.col("id").alias("src")), "src", "left_semi").join(stubs.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", F.lit("declares").alias("via"))
    return reach(materialise(inner, "stubs"), seeds, rounds).select("id")


#: Languages and features whose edges depend on more than the files that change.
NEEDS_ALL = ("vhdl", "perl", "sln", "python", "tcl")


def needs_full_link(files: DataFrame, edges: DataFrame, enriched: bool = False) -> bool:
    """Whether a change must be linked in full: enrichment, bindings, or files of languages that link by the whole design."""
    return enriched or not files.where(F.col("language").isin(*NEEDS_ALL)).limit(1).isEmpty() or not edges.where(F.col("kind") == "binds").limit(1).isEmpty()


def merge_gate(metas: list[dict]) -> None:
    """Refuse to merge graphs of unlike roots or versions, or enriched ones."""
    for key in ("root", "schema_version", "codec_version"):
        seen = {str(m.get(key)) for m in metas}
        if len(seen) > 1:
            raise ValueError(f"graphs differ in {key}: {', '.join(sorted(seen))}")
    if any(m.get("enriched") for m in metas):
        raise ValueError("an enriched graph cannot be merged")


def adapter_union(parts: list[DataFrame], key: str, fingerprint: str) -> DataFrame:
    """The union of parts, each key once; keys with unlike fingerprints are an error that names some of them."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    unlike = every.groupBy(key).agg(F.min(fingerprint).alias("a"), F.max(fingerprint).alias("b")).where("a <> b").orderBy(key).limit(5).collect()
    if unlike:
        raise ValueError(f"unlike versions of {', '.join(str(r[key]) for r in unlike)}")
    return every.dropDuplicates([key])


def delta_counters(before: DataFrame, after: DataFrame, keys: list[str], confidence: str = "confidence") -> DataFrame:
    """One row: edges added, removed, upgraded and downgraded in confidence, and unchanged, between two graphs."""
    a = before.groupBy(*keys).agg(F.max(confidence).alias("was"))
    b = after.groupBy(*keys).agg(F.max(confidence).alias("now"))
    j = a.join(b, keys, "full")
    return j.agg(
        F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("now").isNull()).alias("removed"),
        F.count_if(F.col("now") > F.col("was")).alias("upgraded"), F.count_if(F.col("now") < F.col("was")).alias("downgraded"), F.count_if(F.col("now") == F.col("was")).alias("unchanged"),
    )
