"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontam, html, licenses, lines, lm, mixing, negatives, oracles, quality, simhash, toxicity, trie, urls, warc
from tidewatch.llm.common import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.classify(read(spark, sf_dir, "documents"), labels, ("low_quality", "toxic")).withColumnRenamed("id", "doc_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents")).drop("clean_text")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, removed = lines.strip_boilerplate(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return left.select("doc_id", F.col(removed).alias("n_removed"), F.length("text").cast("long").alias("n_chars"), "text")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.fit(urls.labelled_table(spark)))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), licenses.known_digests(spark))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id"))     # pages has no time of capture
    index = warc.archive(read(spark, sf_dir, "pages"), time)
    return index.select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), "refers_to")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(read(spark, sf_dir, "conversations")).drop("enter", "exit")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_toxicity, op2_mixing, op3_simhash, op4_quality, op5_html, op6_line_dedup, op7_url_filter, op8_lm_scoring,
        op9_decontamination, op10_licenses, op11_warc, op12_prefix_trie, op13_hard_negatives)
}
ORACLES: dict[str, str] = {
    "op2_mixing": oracles.MIXING, "op4_quality": oracles.QUALITY, "op6_line_dedup": oracles.LINES,
    "op9_decontamination": oracles.DECONTAMINATION, "op10_licenses": oracles.LICENSES,
    "op11_warc": oracles.WARC, "op12_prefix_trie": oracles.TRIE,
    "op13_hard_negatives": oracles.NEGATIVES,
}
