"""Split, sequence, forecast, alert and rule queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidewatch.config import FEATURES, STATES, AlertConfig, SplitConfig, WindowConfig
from tidewatch.operators import forecast, phases, reports, rules, sequences, splits
from tidewatch.operators import windows as ops
from tidewatch.plans.catalog.common import (
    GRAIN, HOURLY, SHORT, STATE_INDEX_SQL, TEN_MINUTES, big, bigs, doubles, filled_sql, progression_sql, r6, tidy,
    time_sql, unit_sql, windows_sql,
)
from tidewatch.plans.catalog.windows import base, down_sql, kb_sql
from tidewatch.session import durable
from tidewatch.sources.adapters import view

STRATIFIED = GRAIN.split
PURGED = replace(STRATIFIED, purge_windows=1, long_episode_windows=3)
FAMILY = SplitConfig(mode="family", family_val=("SSH-Patator",), family_test=("Bot",))


def split_windows(spark, sf, cfg, window=HOURLY):
    """Windows with their split. The window table is written once: splits and sequences read it several times."""
    windows = durable(ops.time_features(base(spark, sf, window), window))
    return splits.assign_split(windows, cfg, window)


def split_query(cfg, window=HOURLY):
    return lambda s, d: tidy(split_windows(s, d, cfg, window), "day", "window_index", "y_attack", "dominant_family", "split")


def base_sql(window: WindowConfig = HOURLY) -> str:
    w = window.window_seconds
    return f"{windows_sql(w)}, {filled_sql(w)}, {progression_sql(window)}, {time_sql(w)}"


O = "(PARTITION BY day ORDER BY window_index)"


def episode_sql(gap: int = 2) -> str:
    zeros = " AND ".join(f"lead(y_attack, {j}) OVER {O} = 0" for j in range(1, gap + 2))
    return f"""
e1 AS (SELECT *, CASE WHEN y_attack = 1 AND coalesce(lag(y_attack) OVER {O}, 0) = 0 THEN 1 ELSE 0 END AS e_st,
   coalesce(y_attack = 1 AND {zeros} AND lead(y_attack, {gap + 2}) OVER {O} = 1
     AND lead(window_index, {gap + 1}) OVER {O} - window_index <= {gap + 1}, false) AS e_ext FROM timed),
e2 AS (SELECT *, sum(e_st) OVER {O} AS e_run, coalesce(lag(e_ext) OVER {O}, false) AS e_tail FROM e1),
e3 AS (SELECT *, CASE WHEN y_attack = 1 OR e_tail THEN e_run END AS episode FROM e2)"""


def stratified_sql(cfg: SplitConfig, window: WindowConfig = HOURLY, name: str = "splitted") -> str:
    rot = "[" + ", ".join(f"'{r}'" for r in cfg.rotation) + "]"
    f1, f2 = cfg.fractions[0], cfg.fractions[1]
    p = cfg.purge_windows
    purge = f"WHEN (e_pos >= n1 - {p} AND e_pos < n1) OR (e_pos >= n1 + n2 - {p} AND e_pos < n1 + n2) THEN 'ignore'" if p else ""
    return f"""{base_sql(window)}, {episode_sql(window.episode_gap_windows)},
efam AS (SELECT day, episode, CASE WHEN dominant_family <> 'BENIGN' THEN dominant_family END AS fam, count(*) AS n, min(window_index) AS w0
   FROM e3 WHERE episode IS NOT NULL GROUP BY 1, 2, 3),
etab AS (SELECT day, episode, coalesce(fam, 'BENIGN') AS family, sum(n) OVER (PARTITION BY day, episode) AS elen,
   min(w0) OVER (PARTITION BY day, episode) AS start FROM efam
   QUALIFY row_number() OVER (PARTITION BY day, episode ORDER BY fam IS NULL, n DESC, w0) = 1),
esho AS (SELECT day, episode, row_number() OVER (PARTITION BY family ORDER BY day, start) - 1 AS rnk FROM etab WHERE elen < {cfg.long_episode_windows}),
e4 AS (SELECT e3.*, elen, rnk, cume_dist() OVER (PARTITION BY e3.day ORDER BY window_index) AS cd,
   row_number() OVER (PARTITION BY e3.day, e3.episode ORDER BY window_index) - 1 AS e_pos,
   greatest(1, round_even(elen * {f1}::DOUBLE, 0)) AS n1, greatest(1, round_even(elen * {f2}::DOUBLE, 0)) AS n2
   FROM e3 LEFT JOIN etab ON e3.day = etab.day AND e3.episode = etab.episode LEFT JOIN esho ON e3.day = esho.day AND e3.episode = esho.episode),
{name} AS (SELECT * EXCLUDE (elen, rnk, cd, e_pos, n1, n2), CASE WHEN episode IS NULL THEN
    CASE WHEN cd <= {f1}::DOUBLE THEN 'train' WHEN cd <= {f1 + f2}::DOUBLE THEN 'val' ELSE 'test' END
   WHEN rnk IS NOT NULL THEN {rot}[rnk % {len(cfg.rotation)} + 1] {purge}
   WHEN e_pos < n1 THEN 'train' WHEN e_pos < n1 + n2 THEN 'val' ELSE 'test' END AS split FROM e4)"""


OUT = f"SELECT day, window_index, {bigs('y_attack')}, dominant_family, split FROM"


def simple_split_sql(expr: str, window: WindowConfig = HOURLY) -> str:
    return f"WITH {base_sql(window)} SELECT day, window_index, {bigs('y_attack')}, dominant_family, {expr} AS split FROM timed"


CHRONO = (f"CASE WHEN cume_dist() OVER {O} <= 0.6::DOUBLE THEN 'train' WHEN cume_dist() OVER {O} <= {0.6 + 0.2}::DOUBLE THEN 'val' ELSE 'test' END")
BLOCK = "['train', 'train', 'train', 'val', 'test'][CAST((window_index - min(window_index) OVER (PARTITION BY day)) AS BIGINT) % 5 + 1]"
DAYMODE = "CASE WHEN day = 'Thursday' THEN 'val' WHEN day = 'Friday' THEN 'test' ELSE 'train' END"
FAMILY_SQL = f"""WITH {base_sql()}, h AS (SELECT *, CASE dominant_family WHEN 'SSH-Patator' THEN 'val' WHEN 'Bot' THEN 'test' END AS held FROM timed),
n AS (SELECT *, coalesce(last_value(held IGNORE NULLS) OVER (PARTITION BY day ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
   first_value(held IGNORE NULLS) OVER (PARTITION BY day ORDER BY window_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS near FROM h)
SELECT day, window_index, {bigs('y_attack')}, dominant_family, coalesce(CASE WHEN dominant_family = 'BENIGN' THEN near ELSE held END, 'train') AS split FROM n"""


CHRONO_CFG = SplitConfig(mode="episode_chrono")
EPISODE_CHRONO = f"""WITH {base_sql()}, {episode_sql()}, rn AS (SELECT *, row_number() OVER {O} AS rn FROM e3),
sp AS (SELECT day, episode, greatest(min(rn) - 6, 1) AS lo, max(rn) + 6 AS hi,
   greatest(max(window_index) - min(window_index) + 1 + min(rn) - greatest(min(rn) - 6, 1), 1) AS width FROM rn WHERE episode IS NOT NULL GROUP BY 1, 2),
cv AS (SELECT sp.*, a.window_index AS w0 FROM sp JOIN rn a ON a.day = sp.day AND a.rn = sp.lo),
lb AS (SELECT rn.day, rn.window_index, rn.y_attack, rn.dominant_family, (rn.window_index - cv.w0) / cv.width::DOUBLE AS part
  FROM rn LEFT JOIN cv ON cv.day = rn.day AND rn.rn BETWEEN cv.lo AND cv.hi
  QUALIFY row_number() OVER (PARTITION BY rn.day, rn.window_index ORDER BY cv.episode DESC NULLS LAST) = 1)
SELECT day, window_index, {bigs('y_attack')}, dominant_family, CASE
 WHEN y_attack = 0 AND {unit_sql(str(CHRONO_CFG.seed), 'day', 'CAST(window_index AS BIGINT)')} < 0.25::DOUBLE THEN
  CASE WHEN {unit_sql(str(CHRONO_CFG.seed + 1), 'day', 'CAST(window_index AS BIGINT)')} < 0.2::DOUBLE / (1 - 0.6::DOUBLE + 0.000000001::DOUBLE) THEN 'val' ELSE 'test' END
 WHEN part IS NULL OR part <= 0.6::DOUBLE THEN 'train' WHEN part <= {0.6 + 0.2}::DOUBLE THEN 'val' ELSE 'test' END AS split FROM lb"""


def weekday_split(spark, sf):
    rows = durable(ops.time_features(base(spark, sf), HOURLY)).withColumn("date", F.col("day")).withColumn(
        "day", F.date_format(F.col("day").cast("date"), "EEEE"))
    out = splits.assign_split(rows, SplitConfig(mode="day"), HOURLY)
    return tidy(out.select(F.col("date").alias("day"), "window_index", "y_attack", "dominant_family", "split"))


WEEKDAY = f"""WITH {base_sql()} SELECT day, window_index, {bigs('y_attack')}, dominant_family,
 CASE dayname(CAST(day AS DATE)) WHEN 'Thursday' THEN 'val' WHEN 'Friday' THEN 'test' ELSE 'train' END AS split FROM timed"""


def episodes(spark, sf):
    rows = splits.split_episodes(base(spark, sf, TEN_MINUTES), 2)
    return tidy(splits.episode_table(rows))


EPISODES = f"""WITH {base_sql(TEN_MINUTES)}, {episode_sql()},
efam AS (SELECT day, episode, CASE WHEN dominant_family <> 'BENIGN' THEN dominant_family END AS fam, count(*) AS n, min(window_index) AS w0
   FROM e3 WHERE episode IS NOT NULL GROUP BY 1, 2, 3)
SELECT day, {big('episode', 'episode')}, {big('sum(n) OVER (PARTITION BY day, episode)', 'rows')}, {big('min(w0) OVER (PARTITION BY day, episode)', 'start')},
 coalesce(fam, 'BENIGN') AS family FROM efam QUALIFY row_number() OVER (PARTITION BY day, episode ORDER BY fam IS NULL, n DESC, w0) = 1"""


# ---- sequences ------------------------------------------------------------

def seqs(spark, sf):
    windows = durable(ops.guard_features(split_windows(spark, sf, STRATIFIED)))
    return windows, sequences.build_sequences(windows, SHORT)


def joined(col):
    return F.array_join(F.transform(col, lambda v: v.cast("bigint").cast("string")), ",")


def sequence_rows(spark, sf):
    _, rows = seqs(spark, sf)
    return tidy(rows.select(
        "day", "window_index", "split", "dominant_family", "y_now", "is_synthetic", joined(F.col("y_atk")).alias("y_atk"),
        joined(F.col("y_prog")).alias("y_prog"), joined(F.transform("x", lambda v: v[0])).alias("flow_counts"),
        F.element_at("dt", -1).alias("dt_last"), F.col("x_next")[4].alias("next_byte_rate"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v[42]).alias("dstip_entropy_sum")))


L, K = SHORT.history, SHORT.horizon
PAST, AHEAD = f"{O[:-1]} ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW)", f"{O[:-1]} ROWS BETWEEN 1 FOLLOWING AND {K} FOLLOWING)"
SPAN = f"{O[:-1]} ROWS BETWEEN {L - 1} PRECEDING AND {K} FOLLOWING)"


def sequences_sql(name: str = "seq", splitted: str = stratified_sql(STRATIFIED)) -> str:
    return f"""{splitted},
sq0 AS (SELECT day, window_index, y_attack AS y_now, 0 AS is_synthetic, progression_state,
  list(y_attack) OVER {AHEAD} AS y_atk, list({STATE_INDEX_SQL}) OVER {AHEAD} AS y_prog, list(CAST(flow_count AS BIGINT)) OVER {PAST} AS flow_counts,
  ln(1 + greatest(time_since_prev_window, 0)) AS dt_last, lead(byte_rate) OVER {O} AS next_byte_rate, sum(dstip_entropy) OVER {PAST} AS dstip_entropy_sum,
  min(split) OVER {SPAN} AS s0, max(split) OVER {SPAN} AS s1,
  coalesce(first_value(CASE WHEN dominant_family <> 'BENIGN' THEN dominant_family END IGNORE NULLS) OVER
    ({O[1:-1]} ROWS BETWEEN CURRENT ROW AND {K} FOLLOWING), 'BENIGN') AS dominant_family,
  window_index - lag(window_index, {L - 1}) OVER {O} AS back, lead(window_index, {K}) OVER {O} - window_index AS fore FROM splitted),
{name} AS (SELECT * EXCLUDE (s0, s1, back, fore), CASE WHEN s0 = s1 THEN s0 ELSE 'ignore' END AS split FROM sq0 WHERE back = {L - 1} AND fore = {K})"""


SEQUENCES = f"""WITH {sequences_sql()} SELECT day, window_index, split, dominant_family, {bigs('y_now', 'is_synthetic')},
 array_to_string(y_atk, ',') AS y_atk, array_to_string(y_prog, ',') AS y_prog, array_to_string(flow_counts, ',') AS flow_counts,
 {doubles('dt_last', 'next_byte_rate', 'dstip_entropy_sum')} FROM seq"""


def serving(spark, sf):
    windows = ops.guard_features(ops.time_features(base(spark, sf), HOURLY))
    rows = sequences.serving_sequences(windows, SHORT)
    return tidy(rows.select("day", "window_index", "window_start", joined(F.transform("x", lambda v: v[0])).alias("flow_counts")))


SERVING = f"""WITH {base_sql()}, s AS (SELECT day, window_index, window_start, list(CAST(flow_count AS BIGINT)) OVER {PAST} AS fc,
  window_index - lag(window_index, {L - 1}) OVER {O} AS back FROM timed)
SELECT day, window_index, {doubles('window_start')}, array_to_string(fc, ',') AS flow_counts FROM s WHERE back = {L - 1}"""


def leakage(spark, sf):
    windows, rows = seqs(spark, sf)
    return tidy(sequences.leakage_mismatches(rows, windows, SHORT))


LEAKAGE = f"""WITH {sequences_sql()}, o AS (SELECT s.day, s.split AS want, s.window_index + u.o AS window_index
  FROM seq s, (SELECT unnest(generate_series({-(L - 1)}, {K})) AS o) u WHERE s.split <> 'ignore')
SELECT {big('count(*)', 'checked')}, {big('sum(CASE WHEN w.split <> want THEN 1 ELSE 0 END)', 'mismatches')}
FROM o JOIN splitted w ON w.day = o.day AND w.window_index = o.window_index"""


def scaler(spark, sf):
    windows, rows = seqs(spark, sf)
    return tidy(sequences.fit_scaler(rows, windows, SHORT).select("feature", "median", "iqr"))


SCALER = f"""WITH {sequences_sql()}, fx AS (SELECT {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)}
  FROM seq s, (SELECT unnest(generate_series({-(L - 1)}, 0)) AS o) u, splitted w
  WHERE s.split = 'train' AND w.day = s.day AND w.window_index = s.window_index + u.o),
un AS (UNPIVOT fx ON {', '.join(FEATURES)} INTO NAME feature VALUE v),
q AS (SELECT feature, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM un GROUP BY 1)
SELECT feature, {doubles('median')}, {r6('CASE WHEN iqr = 0 THEN 1 ELSE iqr END', 'iqr')} FROM q"""


def weights(spark, sf):
    return tidy(sequences.class_weights(sequences.select_split(seqs(spark, sf)[1], "train")))


WEIGHTS = f"""WITH {sequences_sql()}, z AS (SELECT unnest(y_atk) AS a, unnest(y_prog) AS p FROM seq WHERE split = 'train'),
c AS (SELECT greatest(0.001, least(0.999, avg(a))) AS m, {', '.join(f'sqrt(count(*) / CAST(greatest(count(*) FILTER (p = {i}), 1) AS DOUBLE)) AS w{i}' for i in range(5))} FROM z),
d AS (SELECT *, (w0 + w1 + w2 + w3 + w4) / 5 AS mw FROM c)
SELECT {r6('(1 - m) / m', 'positive_weight')}, {', '.join(r6(f'w{i} / mw', f'state_weight_{i}') for i in range(5))} FROM d"""


# ---- forecasts ------------------------------------------------------------

def transitions(spark, sf):
    return tidy(forecast.transition_table(split_windows(spark, sf, STRATIFIED), K))


TRANS = f"""
tc AS (SELECT state, k, nxt, count(*) AS n FROM (SELECT s.progression_state AS state, s.split, u.k, x.progression_state AS nxt, x.split AS nsplit
  FROM splitted s, (SELECT unnest(generate_series(1, {K})) AS k) u, splitted x WHERE x.day = s.day AND x.window_index = s.window_index + u.k)
  WHERE split = 'train' AND nsplit = 'train' GROUP BY 1, 2, 3),
tr AS (SELECT state, k, nxt, n / sum(n) OVER (PARTITION BY state, k) AS prob FROM tc)"""

TRANSITIONS = f"WITH {stratified_sql(STRATIFIED)}, {TRANS} SELECT state, {bigs('k')}, nxt AS next, {doubles('prob')} FROM tr"


def state_steps(spark, sf):
    windows = durable(split_windows(spark, sf, STRATIFIED))
    table = forecast.transition_table(windows, K)
    anchors = windows.select("day", "window_index", "progression_state", F.col("y_attack").alias("y_now"), "split", "dominant_family")
    return forecast.state_forecast(anchors, table, K)


def state_rows(spark, sf):
    rows = state_steps(spark, sf)
    return tidy(rows.select(
        "day", "window_index", "k", "forecast_state", "state_prob", "attack_prob",
        forecast.top_state(F.col("progression_dist")).alias("ribbon_state"),
        *[F.col("progression_dist")[s].alias(f"p_{s.lower()}") for s in STATES]))


SPREAD = f"""
sp AS (SELECT state, k, {', '.join(f"coalesce(sum(prob) FILTER (nxt = '{s}'), 0) AS q_{s.lower()}" for s in STATES)} FROM tr GROUP BY 1, 2),
st0 AS (SELECT w.day, w.window_index, w.y_attack AS y_now, w.progression_state AS now_state, w.dominant_family, u.k,
  {', '.join(f"coalesce(q_{s.lower()}, CASE WHEN progression_state = '{s}' THEN 1 ELSE 0 END) AS p_{s.lower()}" for s in STATES)}
  FROM splitted w JOIN (SELECT unnest(generate_series(1, {K})) AS k) u ON true LEFT JOIN sp ON sp.state = w.progression_state AND sp.k = u.k),
st1 AS (SELECT *, greatest({', '.join(f'p_{s.lower()}' for s in STATES)}) AS state_prob, p_onset + p_active + p_continuation AS attack_prob FROM st0),
steps AS (SELECT *, CASE {' '.join(f"WHEN p_{s.lower()} = state_prob THEN '{s}'" for s in STATES)} END AS forecast_state FROM st1)"""

STATE_ROWS = f"""WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD}
SELECT day, window_index, {bigs('k')}, forecast_state, {doubles('state_prob', 'attack_prob')}, forecast_state AS ribbon_state,
 {doubles(*[f'p_{s.lower()}' for s in STATES])} FROM steps"""

ALERT = AlertConfig(threshold=0.4)
TEN = WindowConfig()


def phase_steps(spark, sf):
    rows = state_steps(spark, sf).withColumnsRenamed({"progression_state": "now_state", "forecast_state": "progression_state"})
    # families of the window stand in for the forecast family; NULL previous family
    rows = rows.withColumns({"family": F.col("dominant_family"), "family_inferred": (F.col("dominant_family") == "Bot"),
                             "prev_family": F.lit(None).cast("string")})
    return phases.forecast_phases(rows, TEN)


def forecast_phase_rows(spark, sf):
    return tidy(phase_steps(spark, sf), "day", "window_index", "k", "progression_state", "attck_tactic", "attck_phase",
                "attck_techniques", "attck_confidence", "attck_rationale")


def forecast_phase_sql() -> str:
    t = phases.TEXTS
    conf = "coalesce(conf, 'Low')"
    ap, sp = "printf('%.2f', attack_prob)", "printf('%.2f', state_prob)"
    recon = "dominant_family IN ('PortScan', 'Infiltration')"
    inner = (f"CASE WHEN s = 'NORMAL' THEN 'High' WHEN s = 'PRE_ATTACK' AND {recon} THEN 'Medium' WHEN s = 'PRE_ATTACK' THEN 'Low' "
             f"WHEN s = 'ACTIVE' AND attack_prob >= 0.15 THEN {conf} ELSE {down_sql(conf, '1')} END")
    return f"""fp AS (SELECT *, forecast_state AS s, forecast_state IN ('ONSET', 'ACTIVE', 'CONTINUATION') AND dominant_family = 'BENIGN' AS blind,
  dominant_family = 'Bot' AS guessed FROM steps LEFT JOIN kb ON fam = dominant_family),
fq AS (SELECT *, {inner} AS c0,
  CASE WHEN s = 'NORMAL' THEN '{t['NORMAL']}'
   WHEN s = 'PRE_ATTACK' AND {recon} THEN replace(replace('{t['PRE_RECON']}', '%d', '3'), '%s', dominant_family)
   WHEN s = 'PRE_ATTACK' THEN replace('{t['PRE_OTHER']}', '%s', dominant_family)
   WHEN s = 'ONSET' THEN 'first window carrying a confirmed ' || dominant_family || ' label; tactic per knowledge base but downgraded - single-window evidence (attack_ratio=' || {ap} || ')'
   WHEN s = 'ACTIVE' THEN 'sustained ' || dominant_family || ' activity (attack_ratio=' || {ap} || '); ' || coalesce(note, '')
   ELSE dominant_family || ' episode tail (attack_ratio=' || {ap} || '); activity persisting or winding down' END AS r0 FROM fp)
SELECT day, window_index, {bigs('k')}, s AS progression_state,
 CASE WHEN blind THEN CASE s WHEN 'ONSET' THEN 'Execution / Initial Access' WHEN 'ACTIVE' THEN 'Impact' ELSE 'Impact / Persistence' END
  WHEN s = 'NORMAL' THEN 'None' WHEN s = 'PRE_ATTACK' AND {recon} THEN 'Reconnaissance' WHEN s = 'PRE_ATTACK' THEN 'Reconnaissance (inferred)' ELSE tactic END AS attck_tactic,
 CASE WHEN blind THEN CASE s WHEN 'ONSET' THEN 'Exploitation' ELSE 'Actions on Objectives' END
  WHEN s = 'NORMAL' THEN 'None' WHEN s = 'PRE_ATTACK' THEN 'Reconnaissance' ELSE phase END AS attck_phase,
 CASE WHEN blind OR s = 'NORMAL' THEN '' WHEN s = 'PRE_ATTACK' AND {recon} THEN 'T1595;T1590' WHEN s = 'PRE_ATTACK' THEN 'T1590' ELSE techniques END AS attck_techniques,
 {down_sql(f"(CASE WHEN blind THEN 'Low' WHEN guessed THEN {down_sql('c0', '1')} ELSE c0 END)", '1 + (k - 1) // 3')} AS attck_confidence,
 'forecast +' || (k * 10) || 's (step k=' || k || '); P(state)=' || {sp} || ', P(attack)=' || {ap} || '. ' ||
 CASE WHEN blind THEN '{t['NO_FAMILY']}' WHEN guessed THEN replace('{t['GUESSED']}', '%s', dominant_family) ELSE '' END || r0 AS attck_rationale FROM fq"""


FORECAST_PHASES = f"WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD}, {kb_sql()}, {forecast_phase_sql()}"


def nested(spark, sf):
    steps = phase_steps(spark, sf).withColumn("horizon_seconds", F.col("k") * 10.0)
    rows = forecast.nest_horizon(steps, ["day", "window_index", "y_now"],
                                 ["horizon_seconds", "attack_prob", "progression_state", "attck_phase", "attck_confidence"])
    return forecast.anchors_with_alert(rows, ALERT, SHORT, TEN)


def alert_rows(spark, sf):
    rows = nested(spark, sf).withColumn("first_alert_k", F.coalesce("first_alert_k", F.lit(0)))  # 0: no alert
    return tidy(rows, "day", "window_index", "first_alert_k", "alert", "lead_time_seconds", "max_attack_prob")


ANCHORS = f"""anc AS (SELECT day, window_index, y_now, min(k) FILTER (attack_prob >= 0.4) AS first_alert_k, max(attack_prob) AS max_attack_prob FROM steps GROUP BY 1, 2, 3),
al AS (SELECT *, first_alert_k IS NOT NULL AS alert, CASE WHEN first_alert_k IS NULL THEN 0 ELSE ({K} - first_alert_k + 1) * 10 END AS lead_time_seconds FROM anc)"""
ALERTS = f"""WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD}, {ANCHORS}
SELECT day, window_index, {big('coalesce(first_alert_k, 0)', 'first_alert_k')}, alert, {doubles('lead_time_seconds', 'max_attack_prob')} FROM al"""


def persistence_rows(spark, sf):
    rows = forecast.persistence(split_windows(spark, sf, STRATIFIED).withColumn("y_now", F.col("y_attack")), K)
    rows = rows.withColumns(forecast.alert_columns(F.col("attack_prob"), K, 10.0, 0.7))
    rows = rows.withColumn("first_alert_k", F.coalesce("first_alert_k", F.lit(0)))
    return tidy(rows, "day", "window_index", "y_now", "first_alert_k", "lead_time_seconds", "max_attack_prob")


PERSISTENCE = f"""WITH {base_sql()} SELECT day, window_index, {big('y_attack', 'y_now')}, CAST(y_attack AS BIGINT) AS first_alert_k,
 {r6(f'CASE WHEN y_attack = 1 THEN {K * 10} ELSE 0 END', 'lead_time_seconds')}, {r6('y_attack', 'max_attack_prob')} FROM timed"""


def blended(spark, sf):
    steps = state_steps(spark, sf)
    one = steps.select("day", "window_index", "k", F.col("y_now").cast("double").alias("attack_prob"))
    two = steps.select("day", "window_index", "k", (F.lit(1.0) - F.col("state_prob")).alias("attack_prob"))
    mixed = forecast.blend(steps, one.unionByName(two), ["day", "window_index"], 0.35)
    return tidy(mixed, "day", "window_index", "k", "attack_prob", "detection_prob")


BLENDED = f"""WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD}
SELECT day, window_index, {bigs('k')}, {doubles('attack_prob')}, {r6('0.35::DOUBLE * attack_prob + 0.65::DOUBLE * (y_now + 1 - state_prob) / 2', 'detection_prob')} FROM steps"""


def draws(spark, sf):
    p = F.col("y_prob")
    dist = F.array((1 - p) * 0.6, (1 - p) * 0.4, p * 0.25, p * 0.45, p * 0.3)
    s = view(spark, sf, "scores").select("day", (F.col("event_id") % 3 + 1).alias("k"), p.alias("prob"), dist.alias("dist"))
    got = forecast.draw_summary(s, ["day"], dist="dist")
    return tidy(got.select("*", *[F.col("state_dist")[i].alias(f"p_{n.lower()}") for i, n in enumerate(STATES)]).drop("state_dist"))


def hot(spark, sf):
    rows = nested(spark, sf)
    return tidy(forecast.showcase(rows, ["day", "window_index"]), "day", "window_index", "kind", "max_attack_prob", "alert")


HOT = f"""WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD}, {ANCHORS},
a AS (SELECT day, window_index, 'attack' AS kind, max_attack_prob, alert FROM al WHERE y_now = 1 ORDER BY max_attack_prob DESC, day, window_index LIMIT 6),
q AS (SELECT day, window_index, 'quiet' AS kind, max_attack_prob, alert FROM al WHERE NOT alert ORDER BY day, window_index LIMIT 2)
SELECT day, window_index, kind, {doubles('max_attack_prob')}, alert FROM (SELECT * FROM a UNION ALL SELECT * FROM q)"""


def peaks(spark, sf):
    return tidy(forecast.peak_step(nested(spark, sf)), "day", "window_index", "peak_prob", "peak_k")


PEAKS = f"""WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD}
SELECT day, window_index, {doubles('attack_prob')}, {bigs('k')} FROM steps
QUALIFY row_number() OVER (PARTITION BY day, window_index ORDER BY attack_prob DESC, k) = 1""".replace("AS attack_prob,", "AS peak_prob,").replace("AS BIGINT) AS k FROM steps\nQ", "AS BIGINT) AS peak_k FROM steps\nQ")


def flat(spark, sf):
    return tidy(forecast.horizon_report(nested(spark, sf), ["day", "window_index", "y_now"],
                                        ["horizon_seconds", "attack_prob", "progression_state"]))


FLAT = f"""WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD} SELECT day, window_index, {bigs('y_now', 'k')}, {r6('k * 10', 'horizon_seconds')},
 {doubles('attack_prob')}, forecast_state AS progression_state FROM steps"""


def summary(spark, sf):
    rows = forecast.forecast_summary(nested(spark, sf))
    return tidy(rows.withColumn("phases", F.array_join("phases", ",")))


def kpi(spark, sf):
    return tidy(forecast.kpis(nested(spark, sf)))


KPIS = f"""WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD}, {ANCHORS}
SELECT {big('count(*) FILTER (alert)', 'alerts')}, {big('count(*)', 'anchors')}, {r6('max(max_attack_prob)', 'peak_prob')},
 {r6('min(lead_time_seconds)', 'earliest_lead_seconds')} FROM al"""

SUMMARY = f"""WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD}, {ANCHORS}, {kb_sql()},
ph AS (SELECT DISTINCT p FROM (SELECT CASE WHEN s = 'NORMAL' THEN 'None' WHEN s = 'PRE_ATTACK' THEN 'Reconnaissance'
   WHEN dominant_family = 'BENIGN' THEN CASE s WHEN 'ONSET' THEN 'Exploitation' ELSE 'Actions on Objectives' END ELSE phase END AS p
   FROM (SELECT *, forecast_state AS s FROM steps) LEFT JOIN kb ON fam = dominant_family) WHERE p NOT IN ('None', 'Attack (unspecified)'))
SELECT {big('count(*)', 'n_anchors')}, {big('count(*) FILTER (alert)', 'n_alerts')}, {r6('round(max(max_attack_prob), 4)', 'max_attack_prob')},
 (SELECT string_agg(p, ',' ORDER BY p) FROM ph) AS phases FROM al"""


# ---- family guess and rules ------------------------------------------------

def guesses(spark, sf):
    windows, rows = seqs(spark, sf)
    sc = sequences.fit_scaler(rows, windows, SHORT)
    median, width = sequences.scale_columns(sc)
    x = sequences.scale_vector(F.array(*[F.col(f) for f in FEATURES]), median, width)
    rows = windows.select("day", "window_index", x.alias("z"))
    got = forecast.guess_family(rows, lambda n: F.col("z")[FEATURES.index(n)])
    return tidy(forecast.choose_family(got), "day", "window_index", "guess", "guess_confidence", "family", "family_inferred", "possible_family")


SCALE_CTES = f"""fx AS (SELECT {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in FEATURES)}
  FROM seq s, (SELECT unnest(generate_series({-(L - 1)}, 0)) AS o) u, splitted w
  WHERE s.split = 'train' AND w.day = s.day AND w.window_index = s.window_index + u.o),
un AS (UNPIVOT fx ON {', '.join(FEATURES)} INTO NAME feature VALUE v),
q AS (SELECT feature, quantile_cont(v, 0.5) AS md, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iq FROM un GROUP BY 1),
mm AS (SELECT map_from_entries(list((feature, [md, CASE WHEN iq = 0 THEN 1 ELSE iq END]))) AS m FROM q)"""


def guess_ctes() -> str:
    """CTEs up to ``ch``: the guess of each window and whether it is sure."""
    z = lambda n: f"((CAST(w.{n} AS DOUBLE) - m['{n}'][1]) / m['{n}'][2])"
    churn = "(" + " + ".join(z(n) for n in forecast.CHURN) + ")"
    groups = {"churn": churn, "focus": f"(-{z('dstip_entropy')} - {z('unique_dst')})",
              "fan": f"({z('unique_dst')} + {z('dstip_entropy')} + {z('fan_out')})"}
    cols = []
    for i, (fam, ws) in enumerate(forecast.FAMILY_WEIGHTS.items()):
        cols.append("(" + " + ".join(f"{w}::DOUBLE * {groups.get(n) or z(n)}" for n, w in ws.items()) + f") AS s{i}")
    fams = list(forecast.FAMILY_WEIGHTS)
    return f"""{sequences_sql()}, {SCALE_CTES},
sc AS (SELECT w.day, w.window_index, {', '.join(cols)} FROM splitted w, mm),
so AS (SELECT *, list_reverse_sort([{', '.join(f's{i}' for i in range(5))}]) AS o FROM sc),
cl AS (SELECT *, o[1] AS top, o[1] - o[2] AS margin, CASE {' '.join(f"WHEN s{i} = o[1] THEN '{f}'" for i, f in enumerate(fams))} END AS f FROM so),
gu AS (SELECT *, CASE WHEN top >= 7 AND margin >= 2.5 THEN f ELSE 'BENIGN' END AS guess,
  CASE WHEN margin >= 5 AND top >= 12 THEN 'Medium' ELSE 'Low' END AS guess_confidence FROM cl),
ch AS (SELECT *, guess <> 'BENIGN' AND guess_confidence = 'Medium' AS family_inferred FROM gu)"""


def guess_sql() -> str:
    return f"""WITH {guess_ctes()}
SELECT day, window_index, guess, guess_confidence, CASE WHEN family_inferred THEN guess ELSE 'BENIGN' END AS family, family_inferred,
 CASE WHEN guess <> 'BENIGN' AND NOT family_inferred THEN guess END AS possible_family FROM ch"""


def anchor_labels(spark, sf):
    windows = split_windows(spark, sf, STRATIFIED)
    busy = ops.assign_windows(view(spark, sf, "flows"), HOURLY)
    busy = ops.dominant_family(busy, ["day", "window_index"])
    return tidy(forecast.anchor_families(windows.select("day", "window_index", "split"), busy), "day", "window_index", "split", "family")


ANCHOR_LABELS = f"""WITH {stratified_sql(STRATIFIED)} SELECT s.day, s.window_index, split, coalesce(dom.dominant_family, '?') AS family
FROM splitted s LEFT JOIN dom ON dom.day = s.day AND dom.window_index = s.window_index"""


def split_peaks(spark, sf):
    marks = split_windows(spark, sf, STRATIFIED).select("day", "window_index", "split")
    rows = durable(nested(spark, sf).join(marks, ["day", "window_index"]))
    return tidy(forecast.simulate_split(rows, "test"), "day", "window_index", "alert", "peak_prob", "peak_k")


SPLIT_PEAKS = f"""WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD}, {ANCHORS},
ts AS (SELECT al.* FROM al JOIN splitted w USING (day, window_index) WHERE w.split = 'test'),
ch AS (SELECT * FROM ts WHERE alert OR (SELECT count(*) FILTER (alert) FROM ts) = 0),
pk AS (SELECT day, window_index, attack_prob, k FROM steps QUALIFY row_number() OVER (PARTITION BY day, window_index ORDER BY attack_prob DESC, k) = 1)
SELECT day, window_index, alert, {r6('attack_prob', 'peak_prob')}, {big('k', 'peak_k')} FROM ch JOIN pk USING (day, window_index)"""


SIX_HOURS = replace(HOURLY, window_seconds=21600.0, stride_seconds=21600.0)


def rule_rows(spark, sf):
    windows = rules.rule_features(ops.aggregate_windows(ops.assign_windows(view(spark, sf, "flows"), SIX_HOURS), SIX_HOURS))
    # scaled volume, so that the throughput rule has something to find
    windows = windows.withColumns({"bytes_per_sec": F.col("byte_count") * 500.0, "packet_rate": F.col("packet_count") * 2.0})
    return tidy(rules.RuleSet().match_table(windows, ["day", "window_index"]).drop("action", "mitre_technique"))


RULES = f"""WITH {windows_sql(21600.0)}, v AS (SELECT day, window_index, syn_ratio, flow_count, byte_count * 500.0::DOUBLE AS bps, packet_count * 2 AS pps,
  CASE WHEN unique_dst_ports > 1 THEN dstport_entropy / log2(unique_dst_ports) ELSE 0 END AS pe FROM win)
SELECT day, window_index, 'RULE-SEC-001' AS rule_id, 'Aggressive TCP SYN Scan' AS rule_name, 'HIGH' AS severity,
  'SYN flag ratio ' || printf('%.1f%%', syn_ratio * 100) || ' across ' || flow_count || ' flows in window' AS matched_value FROM v WHERE syn_ratio >= 0.7 AND flow_count >= 25
UNION ALL SELECT day, window_index, 'RULE-SEC-002', 'Network Port Sweep', 'MEDIUM',
  'Normalized port distribution entropy ' || printf('%.2f', pe) || ' (threshold: 0.85)' FROM v WHERE pe >= 0.85 AND flow_count >= 20
UNION ALL SELECT day, window_index, 'RULE-SEC-003', 'High-Volume Data Velocity', 'HIGH',
  'Outbound throughput spiked to ' || printf('%.2f', bps / 1000000.0::DOUBLE) || ' MB/s' FROM v WHERE bps >= 5000000 OR (bps >= 2000000 AND pps >= 1000)"""


def anchor_rules(spark, sf):
    return tidy(rules.RuleSet().match_table(nested(spark, sf), ["day", "window_index"]), "day", "window_index", "rule_id", "matched_value")


ANCHOR_RULES = f"""WITH {stratified_sql(STRATIFIED)}, {TRANS}, {SPREAD}, {ANCHORS},
hit AS (SELECT * FROM steps WHERE forecast_state IN ('ONSET', 'ACTIVE') AND attack_prob >= 0.7 QUALIFY row_number() OVER (PARTITION BY day, window_index ORDER BY k) = 1)
SELECT day, window_index, 'RULE-AI-004' AS rule_id, 'Predicted ' || forecast_state || ' at +' || (k * 10) || 's with P(attack)=' || printf('%.1f%%', attack_prob * 100) AS matched_value FROM hit
UNION ALL SELECT day, window_index, 'RULE-AI-005', 'Lead time ' || lead_time_seconds || 's remaining with high-confidence probability ' || printf('%.1f%%', max_attack_prob * 100)
 FROM al WHERE alert AND lead_time_seconds > 0 AND lead_time_seconds <= 20 AND max_attack_prob >= 0.85"""


def split_report(fn):
    return lambda s, d: tidy(fn(split_windows(s, d, STRATIFIED)))


SPLIT_SUMMARY = f"""WITH {stratified_sql(STRATIFIED)} SELECT split, {big('count(*)', 'windows')}, {big('sum(y_attack)', 'attack_windows')},
 {r6('round(avg(y_attack), 4)', 'attack_frac')}, string_agg(DISTINCT day, ',' ORDER BY day) AS days,
 coalesce(string_agg(DISTINCT CASE WHEN dominant_family <> 'BENIGN' THEN dominant_family END, ';' ORDER BY CASE WHEN dominant_family <> 'BENIGN' THEN dominant_family END), '') AS families FROM splitted GROUP BY 1"""
SPLIT_STATES = f"""WITH {stratified_sql(STRATIFIED)} SELECT split, {', '.join(big(f"count(*) FILTER (progression_state = '{s}')", s) for s in STATES)} FROM splitted GROUP BY 1"""
FAMILY_SPLITS = f"""WITH {stratified_sql(STRATIFIED)} SELECT dominant_family, {', '.join(big(f"count(*) FILTER (split = '{s}')", f'"{s}"') for s in ('train', 'val', 'test', 'ignore'))} FROM splitted WHERE y_attack = 1 GROUP BY 1"""


def profile(spark, sf):
    windows = split_windows(spark, sf, STRATIFIED)
    return tidy(reports.corpus_profile(windows, L, K, len(FEATURES)))


PROFILE = f"""WITH {stratified_sql(STRATIFIED)} SELECT {big('count(*)', 'n_windows')}, {big('sum(flow_count)', 'n_flows')}, 0::BIGINT AS n_synthetic_windows,
 0::BIGINT AS n_synthetic_attack_windows, {r6("round(avg(y_attack) FILTER (split = 'train'), 4)", 'train_attack_frac_before')},
 {r6("round(avg(y_attack) FILTER (split = 'train'), 4)", 'train_attack_frac_after')}, {L}::BIGINT AS "L", {K}::BIGINT AS "K", {len(FEATURES)}::BIGINT AS n_features FROM splitted"""


def timeline(spark, sf):
    return tidy(reports.attack_timeline(view(spark, sf, "flows")), "flow_id", "day", "attack_family", "minute")


def timeline_sql():
    from tidewatch.sources.adapters import duck
    return f"""WITH flows AS ({duck('flows')}), o AS (SELECT day, min(flow_start_epoch) AS t0 FROM flows GROUP BY 1)
SELECT flow_id, day, attack_family, {r6('(flow_start_epoch - t0) / 60', 'minute')} FROM flows JOIN o USING (day) WHERE is_attack = 1"""


def draws_sql():
    from tidewatch.sources.adapters import duck
    parts = dict(zip(STATES, ("(1 - y_prob) * 0.6", "(1 - y_prob) * 0.4", "y_prob * 0.25", "y_prob * 0.45", "y_prob * 0.3")))
    names = [f"p_{n.lower()}" for n in STATES]
    return f"""WITH s AS ({duck('scores')}), d AS (SELECT day, event_id % 3 + 1 AS k, avg(y_prob) AS attack_prob, stddev_pop(y_prob) AS attack_std,
 quantile_cont(y_prob, 0.025) AS attack_ci_lo, quantile_cont(y_prob, 0.975) AS attack_ci_hi,
 {', '.join(f'avg({e}::DOUBLE) AS {n}' for n, e in zip(names, parts.values()))} FROM s GROUP BY 1, 2)
SELECT day, {bigs('k')}, {doubles('attack_prob', 'attack_std', 'attack_ci_lo', 'attack_ci_hi', *names)}, {r6(f"greatest({', '.join(names)})", 'state_prob')},
 CASE {' '.join(f"WHEN {n} = greatest({', '.join(names)}) THEN '{s}'" for n, s in zip(names, STATES))} END AS progression_state FROM d"""


ENTRIES = {
    "split_stratified": (split_query(STRATIFIED), f"WITH {stratified_sql(STRATIFIED)} {OUT} splitted"),
    "split_stratified_purged": (split_query(PURGED, TEN_MINUTES), f"WITH {stratified_sql(PURGED, TEN_MINUTES)} {OUT} splitted"),
    "split_chronological": (split_query(SplitConfig(mode="chronological")), simple_split_sql(CHRONO)),
    "split_block": (split_query(SplitConfig(mode="block")), simple_split_sql(BLOCK)),
    "split_day_schedule": (weekday_split, WEEKDAY),
    "split_family_holdout": (split_query(FAMILY), FAMILY_SQL),
    "split_episode_chrono": (split_query(CHRONO_CFG), EPISODE_CHRONO),
    "split_episodes": (episodes, EPISODES),
    "split_summary": (split_report(reports.split_summary), SPLIT_SUMMARY),
    "split_states": (split_report(reports.split_states), SPLIT_STATES),
    "split_family_windows": (split_report(reports.family_splits), FAMILY_SPLITS),
    "corpus_profile": (profile, PROFILE),
    "attack_timeline": (timeline, timeline_sql()),
    "sequences": (sequence_rows, SEQUENCES),
    "sequences_serving": (serving, SERVING),
    "sequences_leakage_check": (leakage, LEAKAGE),
    "scaler_fit": (scaler, SCALER),
    "class_weights": (weights, WEIGHTS),
    "forecast_transitions": (transitions, TRANSITIONS),
    "forecast_states": (state_rows, STATE_ROWS),
    "forecast_phases": (forecast_phase_rows, FORECAST_PHASES),
    "forecast_alerts": (alert_rows, ALERTS),
    "forecast_persistence": (persistence_rows, PERSISTENCE),
    "forecast_blend": (blended, BLENDED),
    "forecast_draws": (draws, draws_sql()),
    "forecast_showcase": (hot, HOT),
    "forecast_peaks": (peaks, PEAKS),
    "forecast_anchor_families": (anchor_labels, ANCHOR_LABELS),
    "forecast_split_peaks": (split_peaks, SPLIT_PEAKS),
    "forecast_horizon_report": (flat, FLAT),
    "forecast_summary": (summary, SUMMARY),
    "dashboard_kpis": (kpi, KPIS),
    "family_guess": (guesses, guess_sql()),
    "rules_windows": (rule_rows, RULES),
    "rules_anchors": (anchor_rules, ANCHOR_RULES),
}
