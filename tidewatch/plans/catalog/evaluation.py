"""Evaluation queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import evaluate as ev
from tidewatch.operators import reports
from tidewatch.plans.catalog.common import HOURLY, SHORT, big, bigs, doubles, r6, tidy
from tidewatch.plans.catalog.forecasting import base_sql, seqs, sequences_sql
from tidewatch.plans.catalog.windows import base
from tidewatch.sources.adapters import duck, view

M = ["model_id"]
SCORES = f"sc AS ({duck('scores')})"


def scores(spark, sf):
    return view(spark, sf, "scores")


def at_sql(group: str, source: str, thr: str = "0.5::DOUBLE", name: str = "att") -> str:
    return f"""{name}0 AS (SELECT {group}, count(*) FILTER (y_prob >= {thr} AND y_true = 1) AS tp, count(*) FILTER (y_prob >= {thr} AND y_true = 0) AS fp,
  count(*) FILTER (y_prob < {thr} AND y_true = 0) AS tn, count(*) FILTER (y_prob < {thr} AND y_true = 1) AS fn, count(*) AS n FROM {source} GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0 END AS f1, CASE WHEN fp + tn > 0 THEN fp / CAST(fp + tn AS DOUBLE) ELSE 0 END AS fpr,
  (tp + tn) / CAST(n AS DOUBLE) AS accuracy, tp + fn AS positives FROM {name}0)"""


def rank_sql(group: str, source: str, name: str = "rk") -> str:
    """AUROC from average ranks, average precision and best F1 from cumulative counts over all rows."""
    p = f"PARTITION BY {group}"
    return f"""{name}0 AS (SELECT {group}, y_prob AS s, sum(y_true) AS pos, count(*) AS n FROM {source} GROUP BY ALL),
{name}1 AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER ({p}) AS ap, sum(n) OVER ({p}) AS an FROM {name}0 WINDOW w AS ({p} ORDER BY s DESC)),
{name}r AS (SELECT {group}, y_true, rank() OVER ({p} ORDER BY y_prob) + (count(*) OVER ({p}, y_prob) - 1) / 2.0::DOUBLE AS r FROM {source}),
{name}a AS (SELECT {group}, (sum(r) FILTER (y_true = 1) - sum(y_true) * (sum(y_true) + 1) / 2.0::DOUBLE) / (sum(y_true) * CAST(count(*) - sum(y_true) AS DOUBLE)) AS auroc FROM {name}r GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT {group}, sum(pos * cp / CAST(cn AS DOUBLE)) / max(ap) AS pr_auc, max(2 * cp / CAST(ap + cn AS DOUBLE)) AS f1_best FROM {name}1 GROUP BY ALL) JOIN {name}a USING ({group}))"""


RATES = ["precision", "recall", "f1", "fpr", "accuracy"]


def binary(spark, sf):
    return tidy(ev.binary_scores(scores(spark, sf), M, 0.5))


BINARY = f"""WITH {SCORES}, {at_sql('model_id', 'sc')}, {rank_sql('model_id', 'sc')}
SELECT {bigs('model_id', 'tp', 'fp', 'tn', 'fn', 'n', 'positives')}, {doubles(*RATES, 'auroc', 'pr_auc', 'f1_best')} FROM att JOIN rk USING (model_id)"""

GRID = "[" + ", ".join(repr(float(t)) + "::DOUBLE" for t in np.linspace(0.01, 0.99, 197)) + "]"
GRID99 = "[" + ", ".join(repr(float(t)) + "::DOUBLE" for t in np.linspace(0.01, 0.99, 99)) + "]"


def grid_sql(grid: str) -> str:
    return f"""g AS (SELECT unnest({grid}) AS threshold),
gh AS (SELECT model_id, y_prob, sum(y_true) AS pos, count(*) AS m FROM sc GROUP BY ALL),
g0 AS (SELECT model_id, threshold, coalesce(sum(pos) FILTER (y_prob >= threshold), 0) AS tp, coalesce(sum(m) FILTER (y_prob >= threshold), 0) AS hits, sum(pos) AS p, sum(m) AS n FROM gh, g GROUP BY 1, 2),
g1 AS (SELECT *, hits - tp AS fp, p - tp AS fn, CASE WHEN hits + p > 0 THEN 2 * tp / CAST(hits + p AS DOUBLE) ELSE 0 END AS f1, (hits - tp) / CAST(n - p AS DOUBLE) AS fpr FROM g0)"""


def thresholds(spark, sf):
    counts = ev.score_counts(scores(spark, sf), M)
    return tidy(ev.threshold_table(counts, M, 197).select("model_id", "threshold", "tp", "fp", "fn", "f1", "fpr"))


THRESHOLDS = f"WITH {SCORES}, {grid_sql(GRID)} SELECT {bigs('model_id')}, {doubles('threshold')}, {bigs('tp', 'fp', 'fn')}, {doubles('f1', 'fpr')} FROM g1"


def calibrated(spark, sf):
    counts = ev.score_counts(scores(spark, sf), M)
    return tidy(ev.calibrate_threshold(counts, M).join(ev.fpr_threshold(counts, M).withColumnRenamed("threshold", "fpr_threshold"), M))


CALIBRATED = f"""WITH {SCORES}, {grid_sql(GRID)}, b AS (SELECT model_id, threshold FROM g1 WHERE fpr <= 0.15::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY round(f1, 12) DESC, threshold) = 1),
{grid_sql(GRID99).replace('g AS', 'h AS').replace('gh AS', 'hh AS').replace('FROM gh, g ', 'FROM hh, h ').replace('g0 AS', 'h0 AS').replace('g1 AS', 'h1 AS').replace('FROM g0', 'FROM h0')},
f AS (SELECT model_id, min(threshold) AS fpr_threshold FROM h1 WHERE fpr <= 0.05::DOUBLE GROUP BY 1)
SELECT {bigs('model_id')}, {doubles('threshold')}, {r6('coalesce(fpr_threshold, 0.5)', 'fpr_threshold')} FROM b LEFT JOIN f USING (model_id)"""


def brier(spark, sf):
    return tidy(ev.brier(scores(spark, sf), M))


BRIER = f"WITH {SCORES} SELECT {bigs('model_id')}, {r6('avg((y_prob - y_true) * (y_prob - y_true))', 'brier')} FROM sc GROUP BY 1"


def bins(spark, sf):
    return tidy(ev.reliability_bins(scores(spark, sf), M))


BINS_CTE = f"""{SCORES}, bb AS (SELECT model_id, least(CAST(floor(y_prob * 10) AS INT), 9) AS bin, count(*) AS n, avg(y_prob) AS conf, avg(y_true) AS acc FROM sc GROUP BY 1, 2),
ab AS (SELECT m.model_id, b.bin, coalesce(n, 0) AS n, coalesce(conf, 0) AS conf, coalesce(acc, 0) AS acc FROM (SELECT DISTINCT model_id FROM sc) m
  JOIN (SELECT unnest(generate_series(0, 9)) AS bin) b ON true LEFT JOIN bb ON bb.model_id = m.model_id AND bb.bin = b.bin)"""
BINS = f"WITH {BINS_CTE} SELECT {bigs('model_id', 'bin')}, {r6('bin / 10.0::DOUBLE', 'bin_lo')}, {r6('(bin + 1) / 10.0::DOUBLE', 'bin_hi')}, {bigs('n')}, {doubles('conf', 'acc')} FROM ab"


def ece(spark, sf):
    return tidy(ev.calibration_error(ev.reliability_bins(scores(spark, sf), M), M))


ECE = f"WITH {BINS_CTE} SELECT {bigs('model_id')}, {r6('sum(n * abs(acc - conf)) / sum(n)', 'ece')} FROM ab GROUP BY 1"


def anchors(spark, sf):
    _, rows = seqs(spark, sf)
    probs = F.transform(F.sequence(F.lit(1), F.lit(SHORT.horizon)), lambda k: F.pmod(F.col("window_index") * 31 + k * 17, F.lit(100)) / 100.0)
    preds = F.transform(F.sequence(F.lit(1), F.lit(SHORT.horizon)), lambda k: F.pmod(F.col("window_index") + k, F.lit(5)).cast("int"))
    return rows.withColumns({"attack_prob": probs, "prog": preds})


ANC = f"""{sequences_sql()}, st AS (SELECT day, window_index, split, dominant_family, u.k, y_atk[u.k] AS y_true, y_prog[u.k] AS y_prog,
  ((window_index * 31 + u.k * 17) % 100) / 100.0::DOUBLE AS y_prob, (window_index + u.k) % 5 AS prog
  FROM seq, (SELECT unnest(generate_series(1, {SHORT.horizon})) AS k) u)"""


def horizons(spark, sf):
    steps = ev.explode_horizon(anchors(spark, sf), ["split"])
    return tidy(ev.horizon_table(steps, ["split"], 3600.0, 0.6).withColumns({c: F.coalesce(c, F.lit(-1.0)) for c in ("auroc", "pr_auc", "f1_best")}))


HORIZONS = f"""WITH {ANC}, sk AS (SELECT *, split || '/' || k AS gk FROM st), {at_sql('split, k', 'st', '0.6::DOUBLE')}, {rank_sql('gk', 'sk')},
br AS (SELECT split, k, avg((y_prob - y_true) * (y_prob - y_true)) AS brier FROM st GROUP BY 1, 2)
SELECT split, {bigs('k', 'tp', 'fp', 'tn', 'fn', 'n', 'positives')}, {doubles(*RATES, 'brier')}, {r6('k * 3600', 'horizon_seconds')},
 {r6('coalesce(auroc, -1)', 'auroc')}, {r6('coalesce(pr_auc, -1)', 'pr_auc')}, {r6('coalesce(f1_best, f1)', 'f1_best')}
FROM att JOIN br USING (split, k) LEFT JOIN rk ON rk.gk = split || '/' || k"""


def any_step(spark, sf):
    rows = ev.any_horizon(anchors(spark, sf))
    return tidy(ev.confusion(rows, ["split"], 0.8))


ANY = f"""WITH {ANC}, a AS (SELECT day, window_index, split, max(y_true) AS y_true, max(y_prob) AS y_prob FROM st GROUP BY 1, 2, 3), {at_sql('split', 'a', '0.8::DOUBLE')}
SELECT split, {bigs('tp', 'fp', 'tn', 'fn', 'n', 'positives')}, {doubles(*RATES)} FROM att"""


def accuracy(spark, sf):
    rows = anchors(spark, sf)
    zipped = F.posexplode(F.arrays_zip("y_prog", "prog"))
    steps = rows.select("split", zipped.alias("i", "z")).select("split", (F.col("i") + 1).alias("k"), "z.y_prog", "z.prog")
    return tidy(ev.state_accuracy(steps, ["split"]))


ACCURACY = f"""WITH {ANC} SELECT split, {r6('avg(CASE WHEN y_prog = prog THEN 1 ELSE 0 END)', 'progression_acc')},
 {r6('avg(CASE WHEN y_prog = prog THEN 1 ELSE 0 END) FILTER (k = 1)', 'progression_acc_k1')} FROM st GROUP BY 1"""


def warned(spark, sf):
    rows = base(spark, sf)
    return rows.select("day", "window_index", F.col("y_attack").alias("y_now"), (F.pmod(F.col("window_index") * 37, F.lit(100)) / 100.0).alias("y_prob"))


def leads(spark, sf):
    return tidy(ev.lead_times(warned(spark, sf), ["day"], 3600.0, 0.3, SHORT.horizon))


K = SHORT.horizon
LEAD = f"""{base_sql()}, wa AS (SELECT day, window_index, y_attack AS y_now, ((window_index * 37) % 100) / 100.0::DOUBLE AS y_prob,
  row_number() OVER (PARTITION BY day ORDER BY window_index) AS rn FROM timed),
ons AS (SELECT a.* FROM wa a LEFT JOIN wa b ON b.day = a.day AND b.rn = a.rn - 1 WHERE a.y_now = 1 AND coalesce(b.y_now, 0) = 0),
okk AS (SELECT o.day, o.window_index, o.rn - w.rn AS d FROM ons o JOIN wa w ON w.day = o.day AND w.rn BETWEEN o.rn - {K} AND o.rn - 1
   AND w.y_now = 0 AND w.y_prob >= 0.3::DOUBLE AND o.window_index - w.window_index = o.rn - w.rn),
run AS (SELECT day, window_index, max(d) AS lead FROM (SELECT *, row_number() OVER (PARTITION BY day, window_index ORDER BY d) AS i FROM okk) WHERE i = d GROUP BY 1, 2),
lds AS (SELECT o.day, o.window_index, coalesce(lead, 0) * 3600.0::DOUBLE AS lead_seconds FROM ons o LEFT JOIN run USING (day, window_index))"""
LEADS = f"WITH {LEAD} SELECT day, window_index, {doubles('lead_seconds')} FROM lds"


def lead_stats(spark, sf):
    rows = ev.lead_times(warned(spark, sf), ["day"], 3600.0, 0.3, K).withColumn("model", F.lit("m"))
    return tidy(ev.lead_summary(rows, ["model"]))


LEAD_STATS = f"""WITH {LEAD} SELECT 'm' AS model, {big('count(*)', 'n_episodes')}, {big('count(*) FILTER (lead_seconds > 0)', 'n_episodes_warned')},
 {r6('coalesce(avg(lead_seconds) FILTER (lead_seconds > 0), 0)', 'mean_lead_time_s')}, {r6('coalesce(median(lead_seconds) FILTER (lead_seconds > 0), 0)', 'median_lead_time_s')},
 {r6('max(lead_seconds)', 'max_lead_time_s')}, {r6('count(*) FILTER (lead_seconds > 0) / CAST(count(*) AS DOUBLE)', 'detection_rate')} FROM lds"""


def alarms(spark, sf):
    return tidy(ev.false_alarms(warned(spark, sf), ["day"], 0.3, K, ["day"]))


ALARMS = f"""WITH {LEAD}, s AS (SELECT *, coalesce(max(y_now) OVER (PARTITION BY day ORDER BY window_index ROWS BETWEEN 1 FOLLOWING AND {K} FOLLOWING), 0) AS soon FROM wa)
SELECT day, {r6('avg(CASE WHEN y_prob >= 0.3::DOUBLE AND soon = 0 THEN 1.0 ELSE 0.0 END)', 'false_alarm_rate')} FROM s WHERE y_now = 0 GROUP BY 1"""


def with_family(spark, sf):
    fam = (F.when(F.col("y_true") == 0, "BENIGN").when(F.col("event_id") % 2000 == 16, "Rare")
           .when(F.col("event_id") % 2 == 0, "PortScan").otherwise("Bot"))
    return scores(spark, sf).withColumn("dominant_family", fam)


def families(spark, sf):
    return tidy(ev.per_family_scores(with_family(spark, sf), M, min_support=15).select(
        "model_id", "dominant_family", "skipped", "n", "positives", *[F.coalesce(c, F.lit(-1.0)).alias(c) for c in [*RATES, "auroc", "pr_auc", "f1_best"]]))


FAMS = f"""{SCORES}, fs AS (SELECT *, CASE WHEN y_true = 0 THEN 'BENIGN' WHEN event_id % 2000 = 16 THEN 'Rare' WHEN event_id % 2 = 0 THEN 'PortScan' ELSE 'Bot' END AS fam FROM sc),
sup AS (SELECT model_id, fam, count(*) AS n, sum(y_true) AS positives FROM fs WHERE fam <> 'BENIGN' GROUP BY 1, 2),
mix0 AS (SELECT s.model_id, s.fam AS dominant_family, f.y_true, f.y_prob FROM sup s JOIN fs f ON f.model_id = s.model_id AND (f.fam = s.fam OR f.fam = 'BENIGN') WHERE s.positives >= 15
  UNION ALL SELECT model_id, fam, y_true, y_prob FROM fs WHERE fam = 'BENIGN'),
mix AS (SELECT model_id || '/' || dominant_family AS gk, y_true, y_prob FROM mix0)"""
FAMILIES = f"""WITH {FAMS}, {at_sql('gk', 'mix')}, {rank_sql('gk', 'mix')}
SELECT CAST(split_part(att.gk, '/', 1) AS BIGINT) AS model_id, split_part(att.gk, '/', 2) AS dominant_family, false AS skipped, {bigs('n', 'positives')},
 {', '.join(r6(f'coalesce({c}, -1)', c) for c in RATES)}, {r6('CASE WHEN positives > 0 THEN auroc ELSE -1 END', 'auroc')},
 {r6('CASE WHEN positives > 0 THEN pr_auc ELSE -1 END', 'pr_auc')}, {r6('CASE WHEN positives > 0 THEN f1_best ELSE f1 END', 'f1_best')} FROM att JOIN rk USING (gk)
UNION ALL SELECT CAST(model_id AS BIGINT), fam, true, {bigs('n', 'positives')}, {', '.join(r6('-1', c) for c in [*RATES, 'auroc', 'pr_auc', 'f1_best'])} FROM sup WHERE positives < 15""".replace(
    "(sum(y_true) * CAST(count(*) - sum(y_true) AS DOUBLE))", "nullif(sum(y_true) * CAST(count(*) - sum(y_true) AS DOUBLE), 0)").replace(
    "/ max(ap) AS pr_auc", "/ nullif(max(ap), 0) AS pr_auc").replace("max(2 * cp / CAST(ap + cn AS DOUBLE))", "max(2 * cp / CAST(ap + cn AS DOUBLE))")


def ranked(spark, sf):
    return tidy(reports.rank_models(ev.binary_scores(scores(spark, sf), M).withColumn("model", F.col("model_id").cast("string"))), "model", "place", "pr_auc", "f1_best")


RANKED = f"""WITH {SCORES}, {rank_sql('model_id', 'sc')} SELECT CAST(model_id AS VARCHAR) AS model, {big('row_number() OVER (ORDER BY pr_auc DESC, f1_best DESC, model_id)', 'place')},
 {doubles('pr_auc', 'f1_best')} FROM rk"""


def best_families(spark, sf):
    rows = ev.per_family_scores(with_family(spark, sf), M, min_support=15).withColumnsRenamed({"dominant_family": "family"})
    return tidy(reports.best_per_family(rows.withColumn("model", F.col("model_id").cast("string"))))


BEST = f"""WITH {FAMS}, {at_sql('gk', 'mix')}, {rank_sql('gk', 'mix')}
SELECT split_part(att.gk, '/', 2) AS family, split_part(att.gk, '/', 1) AS model, {doubles('f1_best', 'recall')}, {bigs('positives')} FROM att JOIN rk USING (gk)
WHERE split_part(att.gk, '/', 2) <> 'BENIGN' QUALIFY row_number() OVER (PARTITION BY split_part(att.gk, '/', 2) ORDER BY f1_best DESC, split_part(att.gk, '/', 1)) = 1""".replace(
    "(sum(y_true) * CAST(count(*) - sum(y_true) AS DOUBLE))", "nullif(sum(y_true) * CAST(count(*) - sum(y_true) AS DOUBLE), 0)").replace("/ max(ap) AS pr_auc", "/ nullif(max(ap), 0) AS pr_auc")


def blend(spark, sf):
    rows = scores(spark, sf).withColumns({"p_base": F.col("y_prob"), "p_member": F.pmod(F.col("event_id") * 31, F.lit(97)) / 97.0})
    return tidy(ev.blend_weight(rows, M, ev.default_blend_weights()))


BLEND = f"""WITH {SCORES}, w AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in ev.default_blend_weights())}]) AS weight),
bw AS (SELECT model_id || '/' || weight AS gk, model_id, weight, y_true, round(y_prob * weight + ((event_id * 31) % 97) / 97.0::DOUBLE * (1 - weight), 9) AS y_prob FROM sc, w),
ks AS (SELECT DISTINCT gk, model_id, weight FROM bw), {rank_sql('gk', 'bw')}
SELECT {bigs('model_id')}, {doubles('weight', 'pr_auc')} FROM rk JOIN ks USING (gk) QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY round(pr_auc, 12) DESC, weight) = 1"""


def latest(spark, sf):
    rows = scores(spark, sf).withColumn("session_id", F.col("model_id"))
    return tidy(reports.last_per_group(rows, ["session_id"], ["event_id"], 200), "session_id", "event_id", "y_prob")


LATEST = f"WITH {SCORES} SELECT CAST(model_id AS BIGINT) AS session_id, event_id, {doubles('y_prob')} FROM sc QUALIFY row_number() OVER (PARTITION BY model_id ORDER BY event_id DESC) <= 200"


ENTRIES = {
    "eval_binary_scores": (binary, BINARY),
    "eval_threshold_table": (thresholds, THRESHOLDS),
    "eval_calibrated_threshold": (calibrated, CALIBRATED),
    "eval_brier": (brier, BRIER),
    "eval_reliability_bins": (bins, BINS),
    "eval_calibration_error": (ece, ECE),
    "eval_horizon_table": (horizons, HORIZONS),
    "eval_any_horizon": (any_step, ANY),
    "eval_state_accuracy": (accuracy, ACCURACY),
    "eval_lead_times": (leads, LEADS),
    "eval_lead_summary": (lead_stats, LEAD_STATS),
    "eval_false_alarms": (alarms, ALARMS),
    "eval_per_family": (families, FAMILIES),
    "eval_best_per_family": (best_families, BEST),
    "eval_model_ranking": (ranked, RANKED),
    "eval_blend_weight": (blend, BLEND),
    "latest_per_session": (latest, LATEST),
}
