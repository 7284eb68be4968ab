"""Live path in its batch form: forecasts of closed windows per session, session counters, latest rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch.config import FEATURES, STATES
from tidewatch.operators import explain, forecast
from tidewatch.operators.sequences import serving_sequences
from tidewatch.plans.catalog.common import (
    GRAIN, HOURLY, SHORT, big, bigs, doubles, filled_sql, progression_sql, r6, tidy, time_sql, windows_sql,
)
from tidewatch.plans.catalog.forecasting import STRATIFIED, TRANS, split_windows, stratified_sql
from tidewatch.plans.catalog.windows import CLOSED_CTES, sessions
from tidewatch.plans.corpus import state_windows
from tidewatch.session import stored
from tidewatch.sources.adapters import duck, view
from tidewatch.streaming import live
from tidewatch.streaming import windows as stream

L, K = SHORT.history, SHORT.horizon
CFG = replace(GRAIN, alert=replace(GRAIN.alert, threshold=0.4))
HINT = "PortScan"
STEPS = range(1, K + 1)


def live_rows(spark, sf):
    """Each session's anchors scored with the fitted state table, as the stream scores them; one session per protocol."""
    table = forecast.transition_table(split_windows(spark, sf, STRATIFIED), K)
    windows = stored(stream.closed_windows(sessions(spark, sf), HOURLY, 0.0, size_step=None), "closed-windows")
    return live.live_forecasts(stream.batch_anchors(windows, HOURLY, SHORT), live.outlook_table(spark, table, CFG, HINT), None, HINT)


def forecasts(spark, sf):
    steps = [c for k in STEPS for c in (F.col("horizon")[k - 1]["progression_state"].alias(f"state_{k}"), F.col("horizon")[k - 1]["attack_prob"].alias(f"prob_{k}"))]
    return tidy(live_rows(spark, sf).select(
        "session_id", "window_index", "window_start", F.col("now").alias("progression_state"), F.coalesce("first_alert_k", F.lit(0)).alias("first_alert_k"),
        "alert", "lead_time_seconds", "max_attack_prob", *steps,
        F.array_join(F.array_sort(F.transform("matched_rules", lambda m: m["rule_id"])), ",").alias("rule_ids")))


LIVE = f"""sp AS (WITH {stratified_sql(STRATIFIED)}, {TRANS}
  SELECT state, k, {', '.join(f"coalesce(sum(prob) FILTER (nxt = '{s}'), 0) AS q_{s.lower()}" for s in STATES)} FROM tr GROUP BY 1, 2),
closed AS (WITH {CLOSED_CTES} SELECT * FROM win), {filled_sql(source='closed')},
ra AS (SELECT *, CASE WHEN attack_flows >= {HOURLY.min_attack_flows} AND attack_ratio >= {HOURLY.min_attack_ratio} THEN 1 ELSE 0 END AS raw FROM filled),
vo AS (SELECT *, CASE WHEN avg(raw) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 0.5 THEN 1 ELSE 0 END AS atk,
  avg(raw) OVER (o ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 0.5 AS now_atk, window_index - lag(window_index, {L - 1}) OVER o AS back
  FROM ra WINDOW o AS (PARTITION BY day ORDER BY window_index)),
sr AS (SELECT *, CASE WHEN atk = 1 AND coalesce(lag(atk) OVER (PARTITION BY day ORDER BY window_index), 0) = 0 THEN 1 ELSE 0 END AS st FROM vo),
eo AS (SELECT *, sum(st) OVER (PARTITION BY day ORDER BY window_index) AS ep FROM sr),
rn AS (SELECT *, max(attack_ratio) OVER r AS top,
  coalesce(last_value(CASE WHEN dominant_family <> 'BENIGN' THEN dominant_family END IGNORE NULLS) OVER r, 'BENIGN') AS fam
  FROM eo WINDOW r AS (PARTITION BY day, atk, ep ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
lg AS (SELECT *, coalesce(lag(atk) OVER o, 0) AS was, greatest(lag(top) OVER o, attack_ratio) AS peak, coalesce(lag(fam) OVER o, 'BENIGN') AS prev
  FROM rn WINDOW o AS (PARTITION BY day ORDER BY window_index)),
an AS (SELECT *, CASE WHEN NOT now_atk THEN 'NORMAL' WHEN was = 0 THEN 'ONSET'
  WHEN attack_ratio < 0.5 * peak OR (dominant_family <> 'BENIGN' AND dominant_family <> prev) THEN 'CONTINUATION' ELSE 'ACTIVE' END AS now_state,
  CASE WHEN unique_dst_ports > 1 THEN dstport_entropy / log2(unique_dst_ports) ELSE 0 END AS pe FROM lg),
s0 AS (SELECT day, window_index, now_state, u.k, {', '.join(f"coalesce(q_{s.lower()}, CASE WHEN now_state = '{s}' THEN 1 ELSE 0 END) AS p_{s.lower()}" for s in STATES)}
  FROM an JOIN (SELECT unnest(generate_series(1, {K})) AS k) u ON true LEFT JOIN sp ON sp.state = now_state AND sp.k = u.k WHERE back = {L - 1}),
s1 AS (SELECT *, greatest({', '.join(f'p_{s.lower()}' for s in STATES)}) AS state_prob, p_onset + p_active + p_continuation AS attack_prob FROM s0),
s2 AS (SELECT *, CASE {' '.join(f"WHEN p_{s.lower()} = state_prob THEN '{s}'" for s in STATES)} END AS s FROM s1),
fc AS (SELECT day, window_index, coalesce(min(k) FILTER (attack_prob >= 0.4), 0) AS first_alert_k, max(attack_prob) AS max_attack_prob,
  {', '.join(f"max(s) FILTER (k = {k}) AS state_{k}, max(attack_prob) FILTER (k = {k}) AS prob_{k}" for k in STEPS)},
  max(s IN ('ONSET', 'ACTIVE') AND attack_prob >= 0.7) AS foreseen FROM s2 GROUP BY 1, 2),
al AS (SELECT *, first_alert_k > 0 AS alert, CASE WHEN first_alert_k > 0 THEN ({K} - first_alert_k + 1) * 3600 ELSE 0 END AS lead_time_seconds FROM fc),
live AS (SELECT al.*, an.window_start, an.now_state, concat_ws(',', CASE WHEN foreseen THEN 'RULE-AI-004' END,
  CASE WHEN alert AND lead_time_seconds > 0 AND lead_time_seconds <= 20 AND max_attack_prob >= 0.85 THEN 'RULE-AI-005' END,
  CASE WHEN syn_ratio >= 0.7 AND flow_count >= 25 THEN 'RULE-SEC-001' END, CASE WHEN pe >= 0.85 AND flow_count >= 20 THEN 'RULE-SEC-002' END,
  CASE WHEN byte_rate >= 5000000 OR (byte_rate >= 2000000 AND packet_rate >= 1000) THEN 'RULE-SEC-003' END) AS rule_ids
  FROM al JOIN an USING (day, window_index))"""

FORECASTS = f"""WITH {LIVE} SELECT day AS session_id, window_index, {doubles('window_start')}, now_state AS progression_state, {bigs('first_alert_k')}, alert,
 {doubles('lead_time_seconds', 'max_attack_prob')}, {', '.join(f'state_{k}' for k in STEPS)}, {doubles(*[f'prob_{k}' for k in STEPS])}, rule_ids FROM live"""


def counters(spark, sf):
    """Flows, windows scored, forecasts and alerts of each session."""
    both = live.flow_counts(sessions(spark, sf)).unionByName(live.forecast_counts(live_rows(spark, sf)))
    return both.groupBy("session_id").agg(*[F.sum(c).alias(c) for c in live.COUNTERS])


COUNTERS = f"""WITH {LIVE}, flows AS ({duck('flows')}), fl AS (SELECT CAST(protocol AS VARCHAR) AS session_id, count(*) AS flows_in FROM flows GROUP BY 1)
SELECT session_id, {bigs('flows_in')}, {big('count(day)', 'windows')}, {big('count(day)', 'forecasts')}, {big('count(*) FILTER (alert)', 'alerts')}
FROM fl LEFT JOIN live ON day = session_id GROUP BY session_id, flows_in"""


def latest(spark, sf):
    return tidy(live.latest_rows(live_rows(spark, sf).select("session_id", "window_index", "alert", "max_attack_prob")))


LATEST = f"""WITH {LIVE} SELECT day AS session_id, {bigs('window_index')}, alert, {doubles('max_attack_prob')} FROM live
QUALIFY row_number() OVER (PARTITION BY day ORDER BY window_index DESC) <= {live.KEPT}"""


WEIGHTS = {f: ((i * 7) % 11 - 5) / 10.0 for i, f in enumerate(FEATURES)}


def explained(spark, sf):
    """The three features that weigh most in each anchor, by a linear explainer."""
    windows = state_windows(view(spark, sf, "flows"), HOURLY)
    return tidy(explain.explanations(serving_sequences(windows, SHORT), explain.LinearExplainer(WEIGHTS)))


EXPLAINED = f"""WITH {windows_sql()}, {filled_sql()}, {progression_sql()}, {time_sql()},
an AS (SELECT *, window_index - lag(window_index, {L - 1}) OVER (PARTITION BY day ORDER BY window_index) AS back FROM timed),
ex AS (SELECT day, window_index, unnest([{', '.join(f"{{'i': {i}, 'f': '{f}', 'v': CAST({f} AS DOUBLE), 'w': {WEIGHTS[f]}::DOUBLE}}" for i, f in enumerate(FEATURES))}]) AS e FROM an WHERE back = {L - 1}),
co AS (SELECT day, window_index, e.i, e.f, e.v, round(e.w * sign(e.v) * ln(1 + abs(e.v)), 6) AS c FROM ex)
SELECT day, window_index, {big('row_number() OVER (PARTITION BY day, window_index ORDER BY abs(c) DESC, i)', 'rank')}, f AS feature, {r6('v', 'value')}, {r6('c', 'contribution')}
FROM co QUALIFY row_number() OVER (PARTITION BY day, window_index ORDER BY abs(c) DESC, i) <= 3"""


ENTRIES = {
    "forecast_explanations": (explained, EXPLAINED),
    "stream_forecasts": (forecasts, FORECASTS),
    "stream_session_counters": (counters, COUNTERS),
    "stream_forecasts_latest": (latest, LATEST),
}
