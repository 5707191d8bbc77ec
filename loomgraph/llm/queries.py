"""The queries of this subpackage's operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, jaccard, langid, mixing, quality_classifier, quality_rules, token_counts, toxicity, warc
from .common import read_table


def crc(key: str = "doc_id"):
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8"))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights at 0.95 of the greatest entropy, at most four passes over a source, all tokens as budget."""
    return mixing.mix(read_table(spark, sf_dir, "documents"), target_entropy=0.95, max_repeat=4.0)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    index = warc.write(pages)
    return warc.digest_of(warc.read(index), pages.schema["page_id"].dataType.simpleString())


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(read_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only documents that hold a benchmark item, once for each item."""
    docs = read_table(spark, sf_dir, "documents")
    benchmark = read_table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, decontaminate.models(docs, benchmark), item_type=benchmark.schema["item_id"].dataType.simpleString())


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc(), F.lit(4)) == 2, F.lit(False))
    dictionaries = langid.learn(docs.where(~held_out), F.col("text"), F.col("lang"), F.col("doc_id"))
    found = langid.identify(docs, dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(crc(), F.lit(3)) == 1, F.lit(False))
    marked = read_table(spark, sf_dir, "labels").where(~held_out & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = toxicity.choose(marked, F.col("toxic"), F.col("doc_id"))
    machine = toxicity.learn(docs, chosen)
    found = toxicity.score(docs, machine)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality_p")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_warc, op3_quality_classifier, op4_jaccard, op5_decontaminate, op6_token_counts, op7_langid, op8_toxicity, op9_quality_rules, op10_html_text)
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc": """
        with p as (
            select page_id, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages
        ), f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
        select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
            case when first < page_id then 'revisit' else 'response' end as record_type,
            case when first < page_id then first end as refers_to
        from p left join f using (payload_digest)
    """,
}
