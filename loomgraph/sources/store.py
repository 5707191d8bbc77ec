"""Graph storage: immutable versions below one folder, and a pointer to the current one.

Readers follow the pointer, so a version that is being written is never seen half; the pointer is replaced by one
rename that overwrites it. Nodes and edges are partitioned by kind, so a query that asks for some kinds lists only their
files, and lie in the order in which they are looked up (nodes by name, edges by the end that questions start from), so that
statistics of files and row groups leave little to read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
#: What brings a stored version up by one.
UPGRADES: dict[int, object] = {}
#: Edges of these kinds are looked up by their target, all others by their source.
BY_TARGET = ("instantiates", "drives", "reads", "imports")
#: Bytes of a row group.
ROW_GROUP = 16 << 20


def _fs(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p, jvm


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def publish(root: str, nodes: DataFrame, edges: DataFrame, extra: dict[str, DataFrame] | None = None, meta: dict | None = None) -> str:
    """Write a version and point to it; returns its name."""
    spark = nodes.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    base = f"{root}/{version}"
    end = F.when(F.col("kind").isin(*BY_TARGET), F.col("dst")).otherwise(F.col("src"))
    for name, df, key in (("nodes", nodes, F.col("name")), ("edges", edges, end)):
        ranged = df.withColumn("_key", key).repartitionByRange("kind", "_key").sortWithinPartitions("kind", "_key").drop("_key")
        ranged.write.option("parquet.block.size", ROW_GROUP).partitionBy("kind").parquet(f"{base}/{name}")
    for name, df in (extra or {}).items():
        df.write.parquet(f"{base}/{name}")
    _write_text(spark, f"{base}/meta.json", json.dumps({"schema_version": SCHEMA_VERSION, **(meta or {})}, sort_keys=True))
    point(spark, root, version)
    return version


def point(spark: SparkSession, root: str, version: str) -> None:
    """Let readers follow ``version`` from now on: before the rename they see the old version, after it the new one."""
    pending = f"{root}/.CURRENT-{uuid.uuid4().hex}"
    _write_text(spark, pending, version)
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    fs, target, _ = _fs(spark, f"{root}/CURRENT")
    overwrite = sc._gateway.new_array(hadoop.Options.Rename, 1)
    overwrite[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration()).rename(hadoop.Path(pending), target, overwrite)


def exists(spark: SparkSession, root: str) -> bool:
    fs, target, _ = _fs(spark, f"{root}/CURRENT")
    return fs.exists(target)


def current(spark: SparkSession, root: str) -> str:
    return f"{root}/{_read_text(spark, f'{root}/CURRENT').strip()}"


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict]:
    base = current(spark, root)
    meta = json.loads(_read_text(spark, f"{base}/meta.json"))
    nodes, edges = spark.read.parquet(f"{base}/nodes"), spark.read.parquet(f"{base}/edges")
    version = meta["schema_version"]
    if version > SCHEMA_VERSION:
        raise ValueError(f"stored by a newer version ({version})")
    while version < SCHEMA_VERSION:
        nodes, edges = UPGRADES[version](nodes, edges)
        version += 1
    return nodes, edges, meta


def replace_sources(old: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """Edges after a scoped change: those of the sources named come from ``new``, all others from ``old``."""
    s = sources.select("src").distinct()
    return old.join(s, "src", "left_anti").unionByName(new.join(s, "src", "left_semi"))


def node_link_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node-link records as JSON lines (sort, value)."""
    n = nodes.select(F.lit("node").alias("sort"), F.to_json(F.struct(*nodes.columns)).alias("value"))
    e = edges.select(F.lit("link").alias("sort"), F.to_json(F.struct(*edges.columns)).alias("value"))
    return n.unionByName(e)


def _xml(c):
    text = F.coalesce(c.cast("string"), F.lit(""))
    for raw, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def graphml_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The body of a GraphML file, one element a line; ``GRAPHML_HEAD`` and ``GRAPHML_TAIL`` stand around it."""

    def data(df: DataFrame, skip: tuple[str, ...]):
        return [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), _xml(F.col(c)), F.lit("</data>"))) for c in df.columns if c not in skip]

    n = nodes.select(F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('">'), F.concat_ws("", *data(nodes, ("id",))), F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('">'), F.concat_ws("", *data(edges, ("src", "dst"))), F.lit("</edge>")).alias("value"))
    return n.unionByName(e)


def graphml_head(nodes: DataFrame, edges: DataFrame) -> str:
    keys = [f'<key id="{c}" for="{what}" attr.name="{c}" attr.type="string"/>' for what, df, skip in (("node", nodes, ("id",)), ("edge", edges, ("src", "dst"))) for c in df.columns if c not in skip]
    return '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n' + "\n".join(dict.fromkeys(keys)) + '\n<graph edgedefault="directed">'


GRAPHML_TAIL = "</graph>\n</graphml>"


def gexf_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The body of a GEXF file (section, value), one element a line: nodes with id and label, edges with their kind as label."""
    n = nodes.select(F.lit("nodes").alias("section"), F.concat(F.lit('<node id="'), _xml(F.col("id")), F.lit('" label="'), _xml(F.coalesce("name", "id")), F.lit('"/>')).alias("value"))
    e = edges.select(F.lit("edges").alias("section"), F.concat(F.lit('<edge source="'), _xml(F.col("src")), F.lit('" target="'), _xml(F.col("dst")), F.lit('" label="'), _xml(F.col("kind")), F.lit('"/>')).alias("value"))
    return n.unionByName(e)


GEXF_HEAD, GEXF_TAIL = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<graph defaultedgetype="directed">', "</graph>\n</gexf>"
