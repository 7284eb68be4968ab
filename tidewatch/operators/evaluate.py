"""Evaluation tables. Scores are reduced to one row per distinct score before anything cumulative."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import BENIGN
from tidewatch.functions.columns import ratio
from tidewatch.functions.grouped import running_totals
from tidewatch.session import durable

MIN_SUPPORT = 8


def score_counts(rows: DataFrame, group: list[str], label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """(group, score) with positives and rows: the only pass over the raw scores."""
    return rows.groupBy(*group, F.col(score).cast("double").alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))


def score_curve(counts: DataFrame, group: list[str]) -> DataFrame:
    """Cumulative positives and rows from the highest score down, plus the totals."""
    return running_totals(counts, group, "score", ["pos", "n"])


def _f1(tp, fp, fn) -> Column:
    return ratio(2.0 * tp, 2.0 * tp + fp + fn)


def confusion(rows: DataFrame, group: list[str], threshold, label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Counts, precision, recall, F1, false-positive rate and accuracy at a threshold (number or column)."""
    hit = F.col(score) >= (threshold if isinstance(threshold, Column) else F.lit(float(threshold)))
    pos = F.col(label) == 1

    def count(c):
        return F.sum(c.cast("long"))

    base = rows.groupBy(*group).agg(
        count(hit & pos).alias("tp"), count(hit & ~pos).alias("fp"), count(~hit & ~pos).alias("tn"),
        count(~hit & pos).alias("fn"), F.count(F.lit(1)).alias("n"))
    return _rates(base)


def _rates(base: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    return base.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": _f1(tp, fp, fn),
        "fpr": ratio(fp, fp + tn), "accuracy": ratio(tp + tn, F.col("n").cast("double")),
        "positives": F.col("tp") + F.col("fn")})


def ranking(counts: DataFrame, group: list[str]) -> DataFrame:
    """AUROC (ties half), average precision and best F1 from the score curve; NULL with one class only."""
    curve = score_curve(counts, group)
    pos, n = F.col("pos").cast("double"), F.col("n").cast("double")
    cp, cn = F.col("cum_pos").cast("double"), F.col("cum_n").cast("double")
    ap, an = F.col("all_pos").cast("double"), F.col("all_n").cast("double")
    neg = n - pos
    below = (an - ap) - (cn - cp)           # negatives with a lower score
    one = curve.groupBy(*group).agg(
        F.sum(pos * (below + neg / 2.0)).alias("_wins"), F.max(ap).alias("_p"), F.max(an - ap).alias("_n"),
        F.sum(pos * cp / cn).alias("_ap"), F.max(_f1(cp, cn - cp, ap - cp)).alias("_f1"))
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    return one.select(
        *group,
        F.when(both, F.col("_wins") / F.when(both, F.col("_p") * F.col("_n"))).alias("auroc"),
        F.when(both, F.col("_ap") / F.when(both, F.col("_p"))).alias("pr_auc"),
        F.when(both, F.col("_f1")).alias("f1_best"))


def binary_scores(rows: DataFrame, group: list[str], threshold: float = 0.5, label: str = "y_true",
                  score: str = "y_prob") -> DataFrame:
    """Threshold scores next to the threshold-free ones."""
    at = confusion(rows, group, threshold, label, score)
    free = ranking(score_counts(rows, group, label, score), group)
    out = at.join(free, group) if group else at.withColumn("_j", F.lit(1)).join(free.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return out.withColumn("f1_best", F.coalesce("f1_best", "f1"))


def threshold_table(counts: DataFrame, group: list[str], steps: int) -> DataFrame:
    """Scores at ``steps`` thresholds from 0.01 to 0.99.

    A threshold only needs how many rows score at or over it, so every distinct score
    is given the last grid step it reaches; sums over the steps give all thresholds.
    The grid is fixed in size and nothing is paired with every row.
    """
    width = 0.98 / (steps - 1)
    grid = F.array(*[F.lit(float(t)) for t in np.linspace(0.01, 0.99, steps)])
    # -1: under the first threshold
    guess = F.floor((F.col("score") - 0.01) / width).cast("int")
    safe = F.least(F.greatest(guess, F.lit(-1)), F.lit(steps - 1))
    up = F.least(safe + 1, F.lit(steps - 1))
    reach = F.when(F.col("score") >= F.element_at(grid, up + 1), up).when(
        (safe >= 0) & (F.col("score") >= F.element_at(grid, F.greatest(safe, F.lit(0)) + 1)), safe).otherwise(safe - 1)
    reach = F.greatest(reach, F.lit(-1))
    per = counts.groupBy(*group, reach.alias("_r")).agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    # at most steps + 1 rows per group: every step, present or not
    total = per.groupBy(*group).agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"),
                                    F.collect_list(F.struct("_r", "pos", "n")).alias("_h"))
    rows = total.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    over = F.filter("_h", lambda h: h["_r"] >= F.col("step"))
    tp = F.aggregate(over, F.lit(0).cast("long"), lambda a, h: a + h["pos"])
    hits = F.aggregate(over, F.lit(0).cast("long"), lambda a, h: a + h["n"])
    base = rows.withColumns({"tp": tp, "_hits": hits}).withColumns({
        "fp": F.col("_hits") - F.col("tp"), "fn": F.col("_p") - F.col("tp"), "n": F.col("_n"),
    }).withColumn("tn", F.col("_n") - F.col("_p") - F.col("fp"))
    return _rates(base.withColumn("threshold", F.element_at(grid, F.col("step") + 1))).drop("_h", "_hits", "_p", "_n")


def calibrate_threshold(counts: DataFrame, group: list[str], target_fpr: float = 0.05) -> DataFrame:
    """Threshold with the best F1 whose FPR stays within max(0.15, 3 x target); first best wins.

    Without such a threshold the best F1 anywhere; 0.5 with one class only.
    """
    limit = max(0.15, 3.0 * target_fpr)
    table = threshold_table(counts, group, 197)
    key = F.struct((-F.round("f1", 12)).alias("f"), F.col("step").alias("s"))
    ok = F.col("fpr") <= limit
    one = table.groupBy(*group).agg(
        F.min_by(F.when(ok, F.col("threshold")), F.when(ok, key)).alias("_in"),
        F.min_by("threshold", key).alias("_any"), F.max("positives").alias("_p"), F.max("n").alias("_n"))
    both = (F.col("_p") > 0) & (F.col("_p") < F.col("_n"))
    return one.select(*group, F.when(both, F.coalesce("_in", "_any")).otherwise(0.5).alias("threshold"))


def fpr_threshold(counts: DataFrame, group: list[str], target_fpr: float = 0.05) -> DataFrame:
    """Smallest of 99 thresholds whose FPR is within the target, else 0.5."""
    table = threshold_table(counts, group, 99)
    ok = F.col("fpr") <= target_fpr
    return table.groupBy(*group).agg(F.coalesce(F.min(F.when(ok, F.col("threshold"))), F.lit(0.5)).alias("threshold"))


def brier(rows: DataFrame, group: list[str], label: str = "y_true", score: str = "y_prob") -> DataFrame:
    d = F.col(score) - F.col(label)
    return rows.groupBy(*group).agg(F.avg(d * d).alias("brier"))


def reliability_bins(rows: DataFrame, group: list[str], bins: int = 10, label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Rows, mean score and positive share per equal bin; the last bin is closed, empty bins show 0."""
    slot = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    inside = rows.where(F.col(score).between(0, 1))
    got = inside.groupBy(*group, slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("conf"), F.avg(F.col(label).cast("double")).alias("acc"))
    whole = got.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("bin", F.struct("n", "conf", "acc")))).alias("_m"))
    out = whole.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).withColumn("_v", F.col("_m")[F.col("bin")])
    return out.select(
        *group, "bin", (F.col("bin") / float(bins)).alias("bin_lo"), ((F.col("bin") + 1) / float(bins)).alias("bin_hi"),
        F.coalesce(F.col("_v.n"), F.lit(0)).alias("n"), F.coalesce(F.col("_v.conf"), F.lit(0.0)).alias("conf"),
        F.coalesce(F.col("_v.acc"), F.lit(0.0)).alias("acc"))


def calibration_error(bins: DataFrame, group: list[str]) -> DataFrame:
    return bins.groupBy(*group).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def explode_horizon(anchors: DataFrame, keep: list[str], truth: str = "y_atk", probs: str = "attack_prob") -> DataFrame:
    """Label and probability arrays -> one row per step."""
    return anchors.select(*keep, F.posexplode(F.arrays_zip(F.col(truth).alias("t"), F.col(probs).alias("p"))).alias("i", "z")).select(
        *keep, (F.col("i") + 1).alias("k"), F.col("z.t").alias("y_true"), F.col("z.p").alias("y_prob"))


def horizon_table(steps: DataFrame, group: list[str], window_seconds: float, threshold: float = 0.5) -> DataFrame:
    by = [*group, "k"]
    out = binary_scores(steps, by, threshold).join(brier(steps, by), by)
    return out.withColumn("horizon_seconds", F.col("k") * float(window_seconds))


def any_horizon(anchors: DataFrame, truth: str = "y_atk", probs: str = "attack_prob") -> DataFrame:
    return anchors.withColumns({"y_true": F.array_max(truth), "y_prob": F.array_max(probs)})


def lead_times(anchors: DataFrame, group: list[str], window_seconds: float, threshold: float, horizon: int,
               now: str = "y_now", score: str = "y_prob", index: str = "window_index") -> DataFrame:
    """One row per attack onset with the length of the warning run that touches it.

    ``group`` has to hold the day, so that days never interleave. The run counts benign,
    warned rows with consecutive indices right before the onset, at most ``horizon``.
    """
    order = W.partitionBy(*group).orderBy(index)
    warn = (F.col(score) >= threshold) & (F.col(now) == 0)
    rows = anchors.withColumns({"_warn": warn, "_next_to": F.col(index) - F.lag(index).over(order) == 1,
                                "_prev": F.lag(now).over(order)})
    # a new run starts on a row that does not warn, or that is not next to its predecessor
    breaks = (~F.col("_warn")) | ~F.coalesce(F.col("_next_to"), F.lit(False))
    rows = rows.withColumn("_run", F.sum(breaks.cast("int")).over(order))
    inside = W.partitionBy(*group, "_run").orderBy(index)
    rows = rows.withColumn("_len", F.when(F.col("_warn"), F.sum(F.col("_warn").cast("int")).over(inside)).otherwise(0))
    before = F.coalesce(F.when(F.col("_next_to"), F.lag("_len").over(order)), F.lit(0))
    rows = rows.withColumn("_lead", F.least(before, F.lit(horizon)) * F.lit(float(window_seconds)))
    onset = (F.col(now) == 1) & (F.coalesce(F.col("_prev"), F.lit(0)) == 0)
    return rows.where(onset).select(*group, index, F.col("_lead").alias("lead_seconds"))


def false_alarms(anchors: DataFrame, group: list[str], threshold: float, horizon: int, by: list[str],
                 now: str = "y_now", score: str = "y_prob", index: str = "window_index") -> DataFrame:
    """Share of benign rows that warn although no attack follows within ``horizon`` rows."""
    ahead = W.partitionBy(*group).orderBy(index).rowsBetween(1, horizon)
    rows = anchors.withColumn("_soon", F.coalesce(F.max(now).over(ahead), F.lit(0))).where(F.col(now) == 0)
    false = ((F.col(score) >= threshold) & (F.col("_soon") == 0)).cast("double")
    return rows.groupBy(*by).agg(F.avg(false).alias("false_alarm_rate"))


def lead_summary(leads: DataFrame, by: list[str], lead: str = "lead_seconds") -> DataFrame:
    """Episodes, warned episodes, and mean / median / maximum of the leads over 0.

    The distinct leads are at most horizon + 1 values, so they are counted before the median.
    """
    counts = leads.groupBy(*by, lead).agg(F.count(F.lit(1)).alias("n"))
    over = F.when(F.col(lead) > 0, F.col(lead))
    one = counts.groupBy(*by).agg(
        F.sum("n").alias("n_episodes"), F.sum(F.when(F.col(lead) > 0, F.col("n")).otherwise(0)).alias("n_episodes_warned"),
        F.coalesce(F.sum(over * F.col("n")) / F.sum(F.when(F.col(lead) > 0, F.col("n"))), F.lit(0.0)).alias("mean_lead_time_s"),
        F.coalesce(F.percentile(over, F.lit(0.5), F.col("n")), F.lit(0.0)).alias("median_lead_time_s"),
        F.max(lead).alias("max_lead_time_s"))
    return one.withColumn("detection_rate", F.col("n_episodes_warned") / F.col("n_episodes"))


def per_family_scores(rows: DataFrame, group: list[str], family: str = "dominant_family", threshold: float = 0.5,
                      min_support: int = MIN_SUPPORT, label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Each family against the shared benign background.

    Benign rows are reduced to score counts first; only those counts are repeated per
    family (families are a short list), so the background is never multiplied row by row.
    Families with fewer than ``min_support`` positives are kept as skipped.
    """
    counts = durable(score_counts(rows.where(~F.col(family).isin("?", "")), [*group, family], label, score))
    own = counts.where(F.col(family) != BENIGN)
    support = own.groupBy(*group, family).agg(F.sum("pos").alias("_pos"), F.sum("n").alias("windows"))
    enough = support.where(F.col("_pos") >= min_support).select(*group, F.col(family).alias("_fam"))
    names = enough.groupBy(*group).agg(F.collect_set("_fam").alias("_fams")) if group else enough.agg(F.collect_set("_fam").alias("_fams")).withColumn("_g", F.lit(1))
    benign = counts.where(F.col(family) == BENIGN)
    on = group or ["_g"]
    left = benign if group else benign.withColumn("_g", F.lit(1))
    shared = left.join(names, on).select(*group, F.explode("_fams").alias(family), "score", "pos", "n")
    merged = own.join(enough.withColumnRenamed("_fam", family), [*group, family], "left_semi").select(*group, family, "score", "pos", "n")
    both = merged.unionByName(shared).unionByName(benign.select(*group, family, "score", "pos", "n"))
    both = both.groupBy(*group, family, "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    by = [*group, family]
    hit = F.col("score") >= threshold
    neg = F.col("n") - F.col("pos")
    at = _rates(both.groupBy(*by).agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, neg).otherwise(0)).alias("tn"), F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum("n").alias("n")))
    scored = at.join(ranking(both, by), by).withColumn("f1_best", F.coalesce("f1_best", "f1")).withColumn("skipped", F.lit(False))
    skipped = support.where(F.col("_pos") < min_support).select(
        *by, F.col("_pos").alias("positives"), F.col("windows").alias("n"), F.lit(True).alias("skipped"))
    return scored.unionByName(skipped, allowMissingColumns=True)


def state_accuracy(steps: DataFrame, group: list[str], truth: str = "y_prog", pred: str = "prog") -> DataFrame:
    same = (F.col(truth) == F.col(pred)).cast("double")
    return steps.groupBy(*group).agg(
        F.avg(same).alias("progression_acc"), F.avg(F.when(F.col("k") == 1, same)).alias("progression_acc_k1"))


def blend_weight(scores: DataFrame, group: list[str], weights: list[float], label: str = "y_true",
                 base: str = "p_base", member: str = "p_member") -> DataFrame:
    """Weight with the best average precision on the given rows; the smaller weight wins ties.

    All weights are scored in one pass: each row yields one score per weight (a short fixed list).
    Array columns (one probability per horizon step) are blended per step and reduced to their maximum.
    """
    kinds = dict(scores.dtypes)

    def mixed(w: float) -> Column:
        if kinds[base].startswith("array"):
            return F.array_max(F.zip_with(base, member, lambda a, b: a * w + b * (1.0 - w)))
        return F.col(base) * w + F.col(member) * (1.0 - w)

    each = F.explode(F.array(*[F.struct(F.lit(float(w)).alias("w"), mixed(float(w)).alias("s")) for w in weights]))
    rows = scores.select(*group, label, each.alias("x")).select(*group, label, F.col("x.w").alias("weight"), F.round("x.s", 9).alias("y_prob"))
    ranked = ranking(score_counts(rows, [*group, "weight"], label), [*group, "weight"])
    best = F.min_by(F.struct("weight", "pr_auc"), F.struct((-F.round("pr_auc", 12)).alias("a"), F.col("weight").alias("w")))
    return ranked.groupBy(*group).agg(best.alias("b")).select(*group, "b.weight", "b.pr_auc")


def default_blend_weights() -> list[float]:
    return [round(0.2 + 0.05 * i, 2) for i in range(14)]
