"""Small report tables over flows, windows, forecasts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import BENIGN, STATES
from tidewatch.functions.columns import first_match
from tidewatch.session import stored


def upload_summary(flows: DataFrame, time: str = "flow_start_epoch") -> DataFrame:
    span = F.max(time) - F.min(time)
    return flows.agg(F.count(F.lit(1)).alias("rows"), span.alias("span_seconds"),
                     F.floor(span / 10).cast("long").alias("est_windows"))


def upload_histograms(flows: DataFrame, label: str = "Label", protocol: str = "protocol") -> DataFrame:
    """Family and protocol counts in one pass: both values of a row are exploded, then counted."""
    text = F.trim(F.coalesce(F.col(label), F.lit("")))
    family = F.when(text == "", BENIGN).otherwise(text)
    proto = F.trim(F.col(protocol).cast("string"))
    named = first_match([(proto == "6", "TCP"), (proto == "17", "UDP")], proto)
    pairs = F.array(F.struct(F.lit("family").alias("kind"), family.alias("value")),
                    F.struct(F.lit("protocol").alias("kind"), named.alias("value")))
    return flows.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("rows"))


def top_values(histogram: DataFrame, n: int, by: str = "rows", name: str = "value") -> DataFrame:
    return histogram.orderBy(F.desc(by), name).limit(n)


def attack_timeline(flows: DataFrame, keys=("day",), time: str = "flow_start_epoch") -> DataFrame:
    """Minutes since the first flow of the day for every attack flow."""
    first = stored(flows.groupBy(*keys).agg(F.min(time).alias("t0")), "origins")
    rows = flows.where(F.col("is_attack") == 1).join(first, list(keys))
    return rows.withColumn("minute", (F.col(time) - F.col("t0")) / 60.0).drop("t0")


def split_summary(windows: DataFrame, day: str = "day") -> DataFrame:
    fam = F.when(F.col("dominant_family") != BENIGN, F.col("dominant_family"))
    per = windows.groupBy("split", day).agg(
        F.count(F.lit(1)).alias("n"), F.sum("y_attack").alias("a"), F.collect_set(fam).alias("f"))
    return per.groupBy("split").agg(
        F.sum("n").alias("windows"), F.sum("a").alias("attack_windows"),
        F.round(F.sum("a") / F.sum("n"), 4).alias("attack_frac"),
        F.array_join(F.array_sort(F.collect_set(day)), ",").alias("days"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("f")))), ";").alias("families"))


def split_states(windows: DataFrame) -> DataFrame:
    return windows.groupBy("split").pivot("progression_state", list(STATES)).count().fillna(0)


def family_splits(windows: DataFrame, splits=("train", "val", "test", "ignore")) -> DataFrame:
    rows = windows.where(F.col("y_attack") == 1)
    return rows.groupBy("dominant_family").pivot("split", list(splits)).count().fillna(0)


def phase_confidence(windows: DataFrame) -> DataFrame:
    return windows.groupBy("attck_phase", "attck_confidence").agg(F.count(F.lit(1)).alias("windows"))


def corpus_profile(windows: DataFrame, history: int, horizon: int, features: int) -> DataFrame:
    """One row: windows, synthetic share, train attack share with and without synthetic windows."""
    train = F.col("split") == "train"
    real = F.col("is_synthetic") == 0

    def share(cond):
        return F.round(F.avg(F.when(cond, F.col("y_attack").cast("double"))), 4)

    return windows.agg(
        F.count(F.lit(1)).alias("n_windows"), F.sum("flow_count").cast("long").alias("n_flows"),
        F.sum((~real).cast("long")).alias("n_synthetic_windows"),
        F.sum(F.when(~real, F.col("y_attack")).otherwise(0)).alias("n_synthetic_attack_windows"),
        share(train & real).alias("train_attack_frac_before"), share(train).alias("train_attack_frac_after"),
    ).withColumns({"L": F.lit(history), "K": F.lit(horizon), "n_features": F.lit(features)})


def last_per_group(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """Newest ``n`` rows of each group (Spark limits each group before the shuffle)."""
    w = W.partitionBy(*group).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def rank_models(scores: DataFrame) -> DataFrame:
    """Best PR-AUC first, then best F1; equal rows by name. One row per model."""
    order = W.orderBy(F.desc("pr_auc"), F.desc("f1_best"), "model")
    return scores.withColumn("place", F.row_number().over(order))


def best_per_family(scores: DataFrame, references=("persistence",)) -> DataFrame:
    rows = scores.where(~F.col("skipped") & (F.col("family") != BENIGN) & ~F.col("model").isin(*references))
    best = F.min_by(F.struct("model", "f1_best", "recall", "positives"), F.struct((-F.col("f1_best")).alias("f"), F.col("model").alias("m")))
    return rows.groupBy("family").agg(best.alias("b")).select("family", "b.*")
