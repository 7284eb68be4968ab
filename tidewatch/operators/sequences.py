"""History / horizon sequences with a span-purity rule, their checks and the robust scaler."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import BENIGN, FEATURES, SequenceConfig
from tidewatch.functions.columns import first_match, log1p_pos
from tidewatch.functions.grouped import exact_quantiles


class LeakageError(RuntimeError):
    """A sequence touches windows of another split."""


def _features(windows: DataFrame, features) -> Column:
    return F.array(*[F.col(f).cast("double") for f in features if f in windows.columns])


def build_sequences(windows: DataFrame, cfg: SequenceConfig = SequenceConfig(), features=FEATURES, keys=("day",)) -> DataFrame:
    """One row per anchor window whose history and horizon are consecutive windows.

    Every array is a window frame over one partition (at most one row per window
    of a day), so nothing is joined and each frame has at most history + horizon rows.
    """
    L, K = cfg.history, cfg.horizon
    order = W.partitionBy(*keys).orderBy("window_index")
    past, ahead, span = order.rowsBetween(-(L - 1), 0), order.rowsBetween(1, K), order.rowsBetween(-(L - 1), K)
    named = F.when(~F.col("dominant_family").isin(BENIGN, "?"), F.col("dominant_family"))
    synthetic = F.col("is_synthetic") if "is_synthetic" in windows.columns else F.lit(0)
    rows = windows.withColumns({"_x": _features(windows, features), "_syn": synthetic.cast("int")})
    rows = rows.select(
        *keys, "window_index", "window_start", F.col("split").alias("_own"),
        F.collect_list("_x").over(past).alias("x"),
        F.collect_list(log1p_pos(F.col("time_since_prev_window"))).over(past).alias("dt"),
        F.lead("_x").over(order).alias("x_next"),
        F.collect_list(F.col("y_attack").cast("int")).over(ahead).alias("y_atk"),
        F.collect_list(F.col("progression_idx").cast("int")).over(ahead).alias("y_prog"),
        F.col("y_attack").cast("int").alias("y_now"),
        F.array_distinct(F.collect_list("split").over(span)).alias("_splits"),
        F.max("_syn").over(span).alias("is_synthetic"),
        F.coalesce(F.first(named, ignorenulls=True).over(order.rowsBetween(0, K)), F.lit(BENIGN)).alias("dominant_family"),
        (F.col("window_index") - F.lag("window_index", L - 1).over(order)).alias("_back"),
        (F.lead("window_index", K).over(order) - F.col("window_index")).alias("_fore"),
    )
    mixed = F.lit("ignore") if cfg.purge_boundary else F.col("_own")
    split = first_match([
        (F.col("is_synthetic") == 1, "train"), (F.size("_splits") == 1, F.element_at("_splits", 1))], mixed)
    return rows.where((F.col("_back") == L - 1) & (F.col("_fore") == K)).withColumn("split", split).drop(
        "_own", "_splits", "_back", "_fore")


def serving_sequences(windows: DataFrame, cfg: SequenceConfig = SequenceConfig(), features=FEATURES, keys=("day",)) -> DataFrame:
    """History only: an anchor for every window with ``history`` consecutive windows behind it."""
    L = cfg.history
    order = W.partitionBy(*keys).orderBy("window_index")
    past = order.rowsBetween(-(L - 1), 0)
    rows = windows.withColumn("_x", _features(windows, features)).select(
        *keys, "window_index", "window_start",
        F.collect_list("_x").over(past).alias("x"),
        F.collect_list(log1p_pos(F.col("time_since_prev_window"))).over(past).alias("dt"),
        (F.col("window_index") - F.lag("window_index", L - 1).over(order)).alias("_back"))
    return rows.where(F.col("_back") == L - 1).drop("_back")


def leakage_mismatches(sequences: DataFrame, windows: DataFrame, cfg: SequenceConfig = SequenceConfig(), keys=("day",)) -> DataFrame:
    """One row with the number of (anchor, offset) pairs whose window carries another split. Must be 0."""
    keys = list(keys)
    offsets = F.explode(F.sequence(F.lit(-(cfg.history - 1)), F.lit(cfg.horizon)))
    kept = sequences.where((F.col("split") != "ignore") & (F.col("is_synthetic") == 0)).select(
        *keys, F.col("split").alias("_want"), "window_index", offsets.alias("_o"))
    kept = kept.withColumn("window_index", F.col("window_index") + F.col("_o")).drop("_o")
    found = kept.join(windows.select(*keys, "window_index", "split"), [*keys, "window_index"])
    return found.agg(
        F.count(F.lit(1)).alias("checked"), F.coalesce(F.sum((F.col("split") != F.col("_want")).cast("long")), F.lit(0)).alias("mismatches"))


def check_sequences(sequences: DataFrame, windows: DataFrame, cfg: SequenceConfig = SequenceConfig(), keys=("day",)) -> None:
    """Raise on an empty train split, a synthetic sequence outside train, or a split mismatch."""
    one = sequences.agg(
        F.coalesce(F.sum((F.col("split") == "train").cast("long")), F.lit(0)).alias("train"),
        F.coalesce(F.sum(((F.col("is_synthetic") == 1) & (F.col("split") != "train")).cast("long")), F.lit(0)).alias("leaked")).first()
    if not one["train"]:
        raise LeakageError("training split is empty")
    if one["leaked"]:
        raise LeakageError(f"{one['leaked']} synthetic sequences outside train")
    bad = leakage_mismatches(sequences, windows, cfg, keys).first()["mismatches"] if cfg.purge_boundary else 0
    if bad:
        raise LeakageError(f"{bad} span windows carry another split")


def covering_counts(sequences: DataFrame, windows: DataFrame, cfg: SequenceConfig = SequenceConfig(), keys=("day",)) -> DataFrame:
    """Windows with ``_w``: how many real train histories cover them (all train ones if none is real)."""
    keys = list(keys)
    train = sequences.where(F.col("split") == "train")
    real = train.where(F.col("is_synthetic") == 0)
    fit = real if real.select("split").take(1) else train
    anchors = fit.select(*keys, "window_index", F.lit(1).alias("_a"))
    later = W.partitionBy(*keys).orderBy("window_index").rangeBetween(0, cfg.history - 1)
    return windows.join(anchors, [*keys, "window_index"], "left").withColumn(
        "_w", F.coalesce(F.sum("_a").over(later), F.lit(0))).where(F.col("_w") > 0).drop("_a")


def fit_scaler(sequences: DataFrame, windows: DataFrame, cfg: SequenceConfig = SequenceConfig(), features=FEATURES,
               keys=("day",)) -> DataFrame:
    """Median and interquartile range per feature over real train histories; range 0 becomes 1.

    A window counts once per history that covers it, so it enters with that count as
    its weight instead of being repeated. The quantiles are located in two levels.
    """
    rows = covering_counts(sequences, windows, cfg, keys)
    values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])
    long = rows.select("_w", F.explode(values).alias("x")).select("_w", "x.i", "x.v")
    q = exact_quantiles(long, ["i"], "v", [0.25, 0.5, 0.75], "_w")
    wide = q.groupBy("i").agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in
                                ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    names = F.array(*[F.lit(f) for f in features])
    width = F.col("q3") - F.col("q1")
    return wide.select("i", F.element_at(names, F.col("i") + 1).alias("feature"), "median",
                       F.when(width == 0, 1.0).otherwise(width).alias("iqr"))


def scale_columns(scaler: DataFrame) -> tuple[Column, Column]:
    """Fitted medians and ranges as array literals (one value per feature, so the size is fixed)."""
    got = sorted(scaler.collect(), key=lambda r: r["i"])
    return F.array(*[F.lit(r["median"]) for r in got]), F.array(*[F.lit(r["iqr"]) for r in got])


def scale_vector(vector: Column, median: Column, width: Column) -> Column:
    return F.zip_with(F.zip_with(vector, median, lambda a, m: a - m), width, lambda a, s: a / s)


def scale_sequences(sequences: DataFrame, scaler: DataFrame) -> DataFrame:
    median, width = scale_columns(scaler)
    out = {"x": F.transform("x", lambda v: scale_vector(v, median, width))}
    if "x_next" in sequences.columns:
        out["x_next"] = scale_vector(F.col("x_next"), median, width)
    return sequences.withColumns(out)


def select_split(sequences: DataFrame, split: str) -> DataFrame:
    return sequences.where(F.col("split") == split)


def class_weights(sequences: DataFrame, states: int = 5) -> DataFrame:
    """Positive weight (1-p)/p over all horizon labels, and sqrt(total/count) state weights over their mean."""
    rows = sequences.select(F.explode(F.arrays_zip("y_atk", "y_prog")).alias("z")).select("z.y_atk", "z.y_prog")
    p = F.least(F.greatest(F.avg("y_atk"), F.lit(1e-3)), F.lit(1 - 1e-3))
    raw = [F.sqrt(F.count(F.lit(1)) / F.greatest(F.sum((F.col("y_prog") == i).cast("long")), F.lit(1))) for i in range(states)]
    one = rows.agg(((1 - p) / p).alias("positive_weight"), *[r.alias(f"_w{i}") for i, r in enumerate(raw)])
    mean = sum(F.col(f"_w{i}") for i in range(states)) / states
    return one.select("positive_weight", *[(F.col(f"_w{i}") / mean).alias(f"state_weight_{i}") for i in range(states)])
