"""Line dedup by the spread of a line over sites.

Lines are known by a 128-bit hash. One aggregation gives a HyperLogLog sketch of the sites of every line; Spark merges the
sketches of all tasks, so a line on every page of the corpus costs one small row a task. Lines whose estimate lies near the
threshold get an exact distinct count, the others are decided by the sketch. Of a boilerplate line the first occurrence
stays, the others go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh, has_word, let, same, store, text_key

MIN_SITES = 10
NEAR = 0.15
"""Estimates within this share of the threshold are counted exactly; the sketch's error is about 1.6 %."""


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


def occurrences(docs: DataFrame, id_column: str, text: str, site: str) -> DataFrame:
    """One row per line with a word: its hash, site and place. A null site is a site of its own."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(id_column).alias("id"), text_key(text).alias("key"),
        F.coalesce(F.concat(F.lit("s"), F.col(site).cast("string")), F.lit("n")).alias("site"),
        F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line"))
    return rows.where(has_word(F.col("line"))).select("id", "key", "site", "pos", *_hashes(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Hashes of the lines on ``min_sites`` sites or more, each with its first place."""
    sketched = store(
        lines.groupBy("h1", "h2").agg(
            F.hll_sketch_agg("site", F.lit(12)).alias("sketch"),
            F.min(F.struct(F.col("id").isNull(), "id", "key", "pos")).alias("first"))
        .select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites * (1 - NEAR)), "line-sites")
    sure = F.col("sites") > min_sites * (1 + NEAR)
    near = sketched.where(~sure).select("h1", "h2")
    counted = (
        lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("one").alias("n")).where(F.col("n") >= min_sites))
    return store(
        sketched.where(sure).select("h1", "h2", "first")
        .unionByName(sketched.join(counted, ["h1", "h2"], "left_semi").select("h1", "h2", "first")), "boilerplate-lines")


def strip_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, id_column: str = "doc_id", text: str = "text",
                      site: str = "source") -> tuple[DataFrame, str]:
    """``docs`` without repeated cross-site lines, and the name of an added column with the number of lines removed.

    A line with a word that stands on ``min_sites`` distinct sites goes, but for its first occurrence by id, text hash and
    place (null ids last). Lines without a word stay. No row goes: a text that loses all its lines becomes empty, a null
    text stays null. Rows that are equal in id and text keep or lose the same lines. Texts are read whole; extra columns stay as they are.
    """
    lines = occurrences(docs, id_column, text, site)
    bad = boilerplate(lines, min_sites)
    hits = (
        lines.join(bad, ["h1", "h2"])
        .where(~F.struct(F.col("id").isNull(), "id", "key", "pos").eqNullSafe(F.col("first")))
        .groupBy("id", "key").agg(F.collect_set("pos").alias("places")))
    mark, places = fresh(docs, "_key", "_places")
    hits = hits.select(F.col("id").alias("_hit_id"), F.col("key").alias("_hit_key"), F.col("places").alias("_hit_places"))
    rows = docs.withColumn(mark, text_key(text))
    joined = rows.join(hits, rows[id_column].eqNullSafe(hits["_hit_id"]) & (rows[mark] == hits["_hit_key"]), "left")
    joined = joined.select(*[rows[c] for c in docs.columns], hits["_hit_places"].alias(places))
    left = let(F.split(F.col(text), "\n"), lambda every: F.array_join(
        F.filter(every, lambda line, i: ~F.array_contains(F.col(places), i)), "\n"))
    changed = F.when(F.col(places).isNull(), F.col(text)).otherwise(left)
    out = joined.withColumns({text: changed, places: F.coalesce(F.size(places), F.lit(0)).cast("long")})
    if "n_chars" in docs.columns and text != "n_chars":
        out = out.withColumn("n_chars", F.when(F.col(places) > 0, F.length(text)).otherwise(F.col("n_chars")).cast(
            docs.schema["n_chars"].dataType))
    return out, places
