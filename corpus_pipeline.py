"""Training-data pipeline over ``documents``: quality, line dedup, near duplicates, benchmark windows, mix of sources.

Each stage works on all rows its predecessor kept and is written as Parquet before the next one reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewatch.llm import decontam, lines, mixing, quality, similar
from tidewatch.llm.common import read, store


WORDS_PER_PHRASE = 20
"""A line fails for a notice's phrase if it has one for so many words; op4 and its SQL fail a line of any length."""


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail a rule go, then documents that fail; the columns of ``documents`` stay."""
    return quality.clean(docs, quality.LineRules(words_per_phrase=WORDS_PER_PHRASE))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on ten or more sources stay once; no document goes."""
    left, removed = lines.strip_boilerplate(docs)
    return left.drop(removed)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies: five-word shingles, Jaccard similarity 0.8 or more.

    The generalised pigeonhole of op3 gives the pairs its fingerprints find. Most near copies differ in more bits than bit groups
    reach, so an exact prefix filter gives the rest; sets of shingles decide on all of them.
    """
    return similar.drop_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a ten-word window of a benchmark item go."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by source rate in random order, with ``replica`` and ``shuffle_key``."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("mix_sources", mix_sources),
]

ORACLE_SQL: str | None = None
"""Fingerprints need XXH64 and groups need reachability; tests/llm compares run() with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
