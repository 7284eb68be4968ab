"""Augmentation, model and serving queries; random noise and iterative fits have no SQL form."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch.config import DAY_SPLIT, AugmentConfig
from tidewatch.functions.columns import first_match
from tidewatch.operators import augment, forecast, models, sequences
from tidewatch.operators import windows as ops
from tidewatch.plans import serve
from tidewatch.plans.catalog.common import GRAIN, HOURLY, SHORT, big, doubles, r6, tidy, unit_sql
from tidewatch.plans.catalog.forecasting import (
    SCALE_CTES, SPREAD, STRATIFIED, TRANS, L, O, base_sql, guess_ctes, seqs, sequences_sql, split_windows, stratified_sql,
)
from tidewatch.plans.catalog.windows import base, kb_sql
from tidewatch.plans.corpus import state_windows
from tidewatch.session import durable
from tidewatch.sources.adapters import view

ONE_VARIANT = AugmentConfig(max_variants=2, rare_below_windows=400)


def scaled(spark, sf):
    """Scaled sequences under the weekday schedule (a day of 24 windows is too short to cut inside)."""
    windows = ops.guard_features(ops.time_features(base(spark, sf), HOURLY))
    weekday = F.date_format(F.col("day").cast("date"), "EEEE")
    windows = durable(windows.withColumn("split", first_match([(weekday == d, s) for d, s in DAY_SPLIT.items()], "train")))
    rows = sequences.build_sequences(windows, SHORT)
    windows_scaler = sequences.fit_scaler(rows, windows, SHORT)
    return windows, durable(sequences.scale_sequences(rows, windows_scaler)), windows_scaler


def augmented(spark, sf):
    windows = split_windows(spark, sf, STRATIFIED).select("day", "window_index", "split")
    out = augment.augment_flows(view(spark, sf, "flows"), windows, ONE_VARIANT, SHORT, HOURLY)
    return tidy(out.groupBy("day", "is_synthetic", "attack_family").agg(
        F.count(F.lit(1)).alias("flows"), F.min("flow_start_epoch").alias("first"), F.max("flow_start_epoch").alias("last")))


def flow_splits(spark, sf):
    windows = split_windows(spark, sf, STRATIFIED).select("day", "window_index", "split")
    rows = augment.flow_split_labels(view(spark, sf, "flows"), windows, HOURLY)
    return tidy(rows.groupBy("day", F.col("_split").alias("split")).agg(F.count(F.lit(1)).alias("flows"), F.sum("is_attack").alias("attacks")))


FLOW_SPLITS = f"""WITH {stratified_sql(STRATIFIED)} SELECT aw.day, coalesce(split, 'train') AS split, {big('count(*)', 'flows')}, {big('sum(aw.is_attack)', 'attacks')}
FROM aw LEFT JOIN splitted s ON s.day = aw.day AND s.window_index = aw.window_index GROUP BY 1, 2"""


def runs(spark, sf):
    rows = ops.assign_windows(view(spark, sf, "flows"), HOURLY).where("is_attack = 1").select("day", "attack_family", "window_index").distinct()
    return tidy(augment.bridged_runs(rows, ["day", "attack_family"], "window_index", 2))


def runs_sql() -> str:
    from tidewatch.plans.catalog.common import assigned_sql
    return f"""WITH {assigned_sql()}, d AS (SELECT DISTINCT day, attack_family, window_index FROM aw WHERE is_attack = 1),
n AS (SELECT *, CASE WHEN coalesce(window_index - lag(window_index) OVER w > 3, true) THEN 1 ELSE 0 END AS nw FROM d WINDOW w AS (PARTITION BY day, attack_family ORDER BY window_index)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY day, attack_family ORDER BY window_index) AS run FROM n)
SELECT day, attack_family, {big('run', 'run')}, {big('min(window_index)', 'start')}, {big('max(window_index)', 'end')} FROM r GROUP BY 1, 2, 3""".replace('AS end ', 'AS "end" ')


def sequence_variants(spark, sf):
    _, rows, _ = scaled(spark, sf)
    got = augment.augment_sequences(sequences.select_split(rows, "train"), ["day", "window_index"])
    return tidy(got.select("day", "window_index", F.size("x").alias("windows"), F.array_max("y_atk").alias("any_attack"),
                           F.element_at(F.element_at("x", -1), 1).alias("last_flow_count")))


def balanced(spark, sf):
    _, rows = seqs(spark, sf)
    train = sequences.select_split(rows, "train")
    got = augment.rebalance(train, ["day", "window_index"], 0.9)
    return tidy(got.groupBy(F.array_max("y_atk").alias("positive")).agg(F.count(F.lit(1)).alias("rows")))


BALANCED = f"""WITH {sequences_sql()}, tr AS (SELECT day, CAST(window_index AS BIGINT) AS wi, list_max(y_atk) > 0 AS pos FROM seq WHERE split = 'train'),
sh AS (SELECT avg(CASE WHEN pos THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS p FROM tr),
w AS (SELECT pos, CASE WHEN p <= 0 OR p >= 0.9::DOUBLE THEN 1.0::DOUBLE WHEN pos THEN 0.9::DOUBLE / p ELSE (1.0::DOUBLE - 0.9::DOUBLE) / (1.0::DOUBLE - p) END AS w,
  {unit_sql('1337', "'more'", 'day', 'wi')} AS u FROM tr, sh)
SELECT CAST(pos AS BIGINT) AS positive, {big('sum(floor(w) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END)', 'rows')} FROM w
GROUP BY 1 HAVING sum(floor(w) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END) > 0"""


def classifier(name, kind):
    def run(spark, sf):
        _, rows, _ = scaled(spark, sf)
        fitted = models.fit_horizons(sequences.select_split(rows, "train"), name, SHORT.horizon, kind)
        got = models.predict(sequences.select_split(rows, "test"), fitted)
        return tidy(got.select("day", "window_index", *[F.col("attack_prob")[k].alias(f"p{k + 1}") for k in range(SHORT.horizon)]))
    return run


def user_predictor(spark, sf):
    def score(x, dt):
        import numpy as np
        return np.clip(np.stack([x[:, -1, 0], x[:, -1, 1], dt[:, -1]], axis=1) / 10.0, 0.0, 1.0)
    _, rows, _ = scaled(spark, sf)
    got = models.predict_with(rows, score, SHORT.horizon)
    return tidy(got.select("day", "window_index", *[F.col("attack_prob")[k].alias(f"p{k + 1}") for k in range(SHORT.horizon)]))


WEEKDAY_SPLIT = f"""{base_sql()},
splitted AS (SELECT *, CASE dayname(CAST(day AS DATE)) WHEN 'Thursday' THEN 'val' WHEN 'Friday' THEN 'test' ELSE 'train' END AS split FROM timed)"""


def _clipped(expression: str, name: str) -> str:
    return r6(f"least(greatest(({expression}) / 10.0::DOUBLE, 0), 1)", name)


USER_PREDICTOR = f"""WITH {sequences_sql(splitted=WEEKDAY_SPLIT)}, {SCALE_CTES}
SELECT s.day, s.window_index, {_clipped("(w.flow_count - m['flow_count'][1]) / m['flow_count'][2]", 'p1')},
 {_clipped("(w.packet_count - m['packet_count'][1]) / m['packet_count'][2]", 'p2')}, {_clipped('s.dt_last', 'p3')}
FROM seq s JOIN splitted w USING (day, window_index), mm"""


def importances(spark, sf):
    _, rows, _ = scaled(spark, sf)
    fitted = models.fit_horizons(sequences.select_split(rows, "train"), "random_forest", 1)
    return models.importance_table(spark, fitted, 0)


def served(spark, sf):
    windows = durable(split_windows(spark, sf, STRATIFIED))
    full = durable(ops.guard_features(windows))
    scaler = sequences.fit_scaler(sequences.build_sequences(full, SHORT), full, SHORT)
    table = forecast.transition_table(windows, SHORT.horizon)
    upload = state_windows(view(spark, sf, "flows"), HOURLY)
    return serve.forecast_anchors(durable(upload), table, scaler, replace(GRAIN, alert=replace(GRAIN.alert, threshold=0.4)))


SERVED = f"""{guess_ctes()}, {TRANS}, {SPREAD}, {kb_sql()},
sv AS (SELECT day, window_index, window_index - lag(window_index, {L - 1}) OVER {O} AS back FROM timed),
fs AS (SELECT s.*, s.forecast_state AS s, CASE WHEN family_inferred THEN guess ELSE 'BENIGN' END AS family
  FROM steps s JOIN sv USING (day, window_index) JOIN ch USING (day, window_index) WHERE back = {L - 1}),
an AS (SELECT day, window_index, any_value(family) AS family, min(k) FILTER (attack_prob >= 0.4) AS first_k, max(attack_prob) AS top FROM fs GROUP BY 1, 2),
fa AS (SELECT *, first_k IS NOT NULL AS alert, CASE WHEN first_k IS NULL THEN 0 ELSE ({SHORT.horizon} - first_k + 1) * 3600 END AS lead FROM an)"""


def documents(spark, sf):
    return serve.documents(served(spark, sf))


def document_fields(spark, sf):
    """Fields read back from the documents' text."""
    def text(path):
        return F.get_json_object("document", f"$.{path}")

    return tidy(documents(spark, sf).select(
        "day", "window_index", text("family").alias("family"), text("alert").cast("boolean").alias("alert"),
        text("lead_time_seconds").cast("double").alias("lead_time_seconds"), text("max_attack_prob").cast("double").alias("max_attack_prob"),
        *[text(f"horizon[{k - 1}].progression_state").alias(f"state_{k}") for k in range(1, SHORT.horizon + 1)],
        *[text(f"horizon[{k - 1}].attack_prob").cast("double").alias(f"prob_{k}") for k in range(1, SHORT.horizon + 1)]))


_STEPS = range(1, SHORT.horizon + 1)
DOCUMENT_FIELDS = f"""WITH {SERVED}, st AS (SELECT day, window_index, {', '.join(f"max(s) FILTER (k = {k}) AS state_{k}, max(attack_prob) FILTER (k = {k}) AS prob_{k}" for k in _STEPS)} FROM fs GROUP BY 1, 2)
SELECT day, window_index, family, alert, {r6('lead', 'lead_time_seconds')}, {r6('top', 'max_attack_prob')},
 {', '.join(f'state_{k}' for k in _STEPS)}, {doubles(*[f'prob_{k}' for k in _STEPS])} FROM fa JOIN st USING (day, window_index)"""


def served_summary(spark, sf):
    got = serve.summary(durable(served(spark, sf)))
    return tidy(got.withColumns({"phases": F.array_join("phases", ","), "matched_rule_ids": F.array_join("matched_rule_ids", ",")}))


SERVED_SUMMARY = f"""WITH {SERVED},
ph AS (SELECT DISTINCT p FROM (SELECT CASE WHEN s = 'NORMAL' THEN 'None' WHEN s = 'PRE_ATTACK' THEN 'Reconnaissance'
   WHEN family = 'BENIGN' THEN CASE s WHEN 'ONSET' THEN 'Exploitation' ELSE 'Actions on Objectives' END ELSE phase END AS p
   FROM fs LEFT JOIN kb ON fam = family) WHERE p NOT IN ('None', 'Attack (unspecified)')),
v AS (SELECT t.*, CASE WHEN unique_dst_ports > 1 THEN dstport_entropy / log2(unique_dst_ports) ELSE 0 END AS pe FROM timed t JOIN fa USING (day, window_index)),
ru AS (SELECT 'RULE-SEC-001' AS id FROM v WHERE syn_ratio >= 0.7 AND flow_count >= 25 UNION ALL SELECT 'RULE-SEC-002' FROM v WHERE pe >= 0.85 AND flow_count >= 20
 UNION ALL SELECT 'RULE-SEC-003' FROM v WHERE byte_rate >= 5000000 OR (byte_rate >= 2000000 AND packet_rate >= 1000)
 UNION ALL SELECT 'RULE-AI-004' FROM fs WHERE s IN ('ONSET', 'ACTIVE') AND attack_prob >= 0.7 GROUP BY day, window_index
 UNION ALL SELECT 'RULE-AI-005' FROM fa WHERE alert AND lead > 0 AND lead <= 20 AND top >= 0.85)
SELECT {big('count(*)', 'n_anchors')}, {big('count(*) FILTER (alert)', 'n_alerts')}, {r6('round(max(top), 4)', 'max_attack_prob')},
 coalesce((SELECT string_agg(p, ',' ORDER BY p) FROM ph), '') AS phases, {big('(SELECT count(*) FROM ru)', 'matched_rules_count')},
 coalesce((SELECT string_agg(DISTINCT id, ',' ORDER BY id) FROM ru), '') AS matched_rule_ids FROM fa"""


ENTRIES = {
    "augment_flow_splits": (flow_splits, FLOW_SPLITS),
    "augment_runs": (runs, runs_sql()),
    "augment_flows": (augmented, None),
    "augment_sequences": (sequence_variants, None),
    "rebalanced_sequences": (balanced, BALANCED),
    "model_logistic_window": (classifier("logistic_regression", models.WINDOW), None),
    "model_logistic_sequence": (classifier("logistic_regression", models.SEQUENCE), None),
    "model_random_forest_window": (classifier("random_forest", models.WINDOW), None),
    "model_linear_svc_window": (classifier("linear_svc", models.WINDOW), None),
    "model_gaussian_nb_window": (classifier("gaussian_nb", models.WINDOW), None),
    "model_gradient_boosting_window": (classifier("gradient_boosting", models.WINDOW), None),
    "model_mlp_window": (classifier("mlp", models.WINDOW), None),
    "model_user_predictor": (user_predictor, USER_PREDICTOR),
    "model_importance": (importances, None),
    "forecast_documents": (documents, None),
    "forecast_document_fields": (document_fields, DOCUMENT_FIELDS),
    "forecast_document_summary": (served_summary, SERVED_SUMMARY),
}
