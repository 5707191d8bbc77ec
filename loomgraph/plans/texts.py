"""Queries on texts and files: discovery, word search, percentiles of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import normal_space, pin_leaf, stripped
from ..sources import discovery

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Suffixes that the documents take in turn when they stand for files.
SUFFIXES = (".sv", ".v", ".vhd", ".txt", ".tcl", ".hxx", ".py", ".sln", ".SV")


@query("""with f as (select 'd/' || doc_id || ['.sv', '.v', '.vhd', '.txt', '.tcl', '.hxx', '.py', '.sln', '.SV'][doc_id % 9 + 1] as path, doc_id % 9 as s,
case when doc_id % 13 = 0 then null when doc_id % 17 = 0 then '`pragma protect begin' || chr(10) || text when doc_id % 5 = 0 then 'import cocotb' || chr(10) || text when doc_id % 7 = 0 then 'Microsoft Visual Studio Solution File' || chr(10) || text else text end as t, doc_id from documents),
g as (select *, octet_length(encode(t)) as size_bytes from f),
h as (select *, case when t is null then 'missing' when s in (3, 8) then 'unsupported' when path like 'd/1%' then 'exclude' when size_bytes > 4096 then 'size' when doc_id % 17 = 0 then 'pragma_protect' when s = 6 and doc_id % 5 <> 0 then 'not_cocotb' when s = 7 and doc_id % 7 = 0 and doc_id % 5 <> 0 then 'visual_studio_solution' end as skipped_reason from g)
select path, ['systemverilog', 'verilog', 'vhdl', 'unknown', 'tcl', 'cpp', 'python', 'sln', 'unknown'][s + 1] as language, case when skipped_reason is null then sha256(t) end as content_hash, size_bytes, skipped_reason from h""")
def src05_discovery(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % 9 + 1).cast("int"))
    head = lambda text: F.concat(F.lit(text + "\n"), F.col("text"))
    every = lambda k: F.col("doc_id") % k == 0
    text = F.when(every(17), head("`pragma protect begin")).when(every(5), head("import cocotb")).when(every(7), head("Microsoft Visual Studio Solution File")).otherwise(F.col("text"))
    t = F.when(~every(13), text)
    rows = d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), suffix).alias("path"), F.encode(t, "UTF-8").alias("content"), F.octet_length(t).cast("long").alias("size_bytes"))
    return discovery.files(rows, exclude=("d/1*",), max_kb=4)


@query("select w as word, count(*) as hits, count(distinct doc_id) as files from (select doc_id, unnest(regexp_split_to_array(text, '[^\\p{L}]+')) as w from documents) where w in ('the', 'que', 'und') group by 1")
def q22_word_search(spark, sf_dir):
    """Whole-word hits in all texts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w.isin("the", "que", "und"))).alias("word")).groupBy("word").agg(F.count("*").alias("hits"), F.countDistinct("doc_id").alias("files"))


@query("select source, sum(cast(ceil(length(text) / 4.0) as bigint)) as tokens, median(length(text)) as median_chars from documents group by 1")
def ag19_token_estimate(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.sum(F.ceil(F.length("text") / 4.0).cast("long")).cast("decimal(38,0)").alias("tokens"), F.expr("percentile(length(text), 0.5)").alias("median_chars"))


@query("select source, doc_id, n from (select source, doc_id, row_number() over (partition by source order by doc_id) as n from documents) where n <= 3")
def sl06_interleave(spark, sf_dir):
    """The first three of each source by rank: a round robin over sources."""
    d = table(spark, sf_dir, "documents")
    w = Window.partitionBy("source").orderBy("doc_id")
    return d.select("source", "doc_id", F.row_number().over(w).alias("n")).where("n <= 3")


@query("select trim(regexp_replace(text, '\\s+', ' ', 'g')) as plain, item_id from benchmark")
def prj10_normal_space(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(normal_space(stripped(F.col("text"))).alias("plain"), "item_id")


@query("select split_part(regexp_extract(url, '([^/]*)$', 1), '[', 1) as leaf, count(*) as n from pages group by 1")
def prj11_leaf(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(pin_leaf(F.col("url")).alias("leaf")).agg(F.count("*").alias("n"))
