"""Uploaded flows -> forecast document (anchors with horizon, phases, rules) and its summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import BENIGN, FEATURES, Config, WindowConfig
from tidewatch.operators import clean, forecast, phases, rules, sequences
from tidewatch.plans.corpus import state_windows
from tidewatch.sources import contract


def upload_windows(upload: DataFrame, cfg: Config = Config(), make_windows: Callable[[DataFrame, WindowConfig], DataFrame] = state_windows) -> DataFrame:
    """Contract, numbers and windows of one upload (day ``upload``); one without a row that has a valid time is rejected.

    ``make_windows`` turns the cleaned flows into windows; a user's own may add features or another cut of time.
    """
    rows = contract.require_rows(contract.normalise_upload(upload))
    rows = clean.type_identity(clean.coerce_numbers(rows))
    return make_windows(contract.to_engine(rows), cfg.window)


STEP_FIELDS = ["horizon_seconds", "attack_prob", "progression_state", "state_prob", "attck_tactic", "attck_techniques", "attck_phase",
               "attck_confidence", "attck_rationale"]


def with_horizon(rows: DataFrame, table: DataFrame, keep: list[str], cfg: Config = Config()) -> DataFrame:
    """Nested horizon, phases and alert of rows with ``keep``, ``progression_state``, ``family`` and ``family_inferred``."""
    steps = forecast.state_forecast(rows.select(*keep, "progression_state"), table, cfg.sequence.horizon)
    steps = steps.drop("progression_state").withColumnRenamed("forecast_state", "progression_state").withColumns(
        {"prev_family": F.lit(None).cast("string"), "horizon_seconds": F.col("k") * float(cfg.window.window_seconds)})
    steps = phases.forecast_phases(steps, cfg.window)
    dist = F.map_filter("progression_dist", lambda _, v: v.isNotNull())
    nested = forecast.nest_horizon(steps.withColumn("dist_json", F.to_json(dist)), keep, [*STEP_FIELDS, "dist_json"])
    return forecast.anchors_with_alert(nested, cfg.alert, cfg.sequence, cfg.window)


def with_family(rows: DataFrame, scaler: DataFrame | None, hint: str | None = None) -> DataFrame:
    """Family of each row from its scaled features, or from ``hint`` alone if there is no scaler."""
    if scaler is None:
        blank = F.lit(None).cast("string")
        return rows.withColumns({"family": F.lit(hint or BENIGN), "family_inferred": F.lit(False), "possible_family": blank, "possible_family_confidence": blank})
    median, width = sequences.scale_columns(scaler)
    rows = rows.withColumn("_z", sequences.scale_vector(F.array(*FEATURES), median, width))
    return forecast.choose_family(forecast.guess_family(rows, lambda n: F.col("_z")[FEATURES.index(n)]), hint).drop("_z", "guess", "guess_confidence")


ANCHOR_FIELDS = ["window_index", "window_start", "family", "family_inferred", "possible_family", "possible_family_confidence",
                 "syn_ratio", "flow_count", "port_entropy", "bytes_per_sec", "packet_rate"]


def forecast_anchors(windows: DataFrame, table: DataFrame, scaler: DataFrame, cfg: Config = Config(),
                     hint: str | None = None, rule_set: rules.RuleSet | None = None) -> DataFrame:
    """One nested row per anchor.

    ``table`` is the lead-k state table of the training windows and ``scaler`` the
    fitted medians and ranges; both are small and fixed in size.
    """
    anchors = sequences.serving_sequences(windows, cfg.sequence).select("day", "window_index")
    rows = windows.join(anchors, ["day", "window_index"], "left_semi")
    rows = rules.rule_features(with_family(rows, scaler, hint))
    return (rule_set or rules.RuleSet()).evaluate(with_horizon(rows, table, ["day", *ANCHOR_FIELDS], cfg))


def summary(anchors: DataFrame) -> DataFrame:
    """Forecast summary with the number of rule matches and the distinct rule ids."""
    one = forecast.forecast_summary(anchors)
    ids = anchors.select(F.explode("matched_rules.rule_id").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    found = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matched_rules_count"), F.array_sort(F.collect_list("id")).alias("matched_rule_ids"))
    stacked = one.unionByName(found, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def documents(anchors: DataFrame) -> DataFrame:
    """One JSON text per anchor."""
    return anchors.select("day", "window_index", F.to_json(F.struct(*anchors.columns)).alias("document"))
