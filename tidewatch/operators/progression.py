"""Attack episodes and progression states at window grain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import ATTACK_STATES, BENIGN, STATES, WindowConfig
from tidewatch.functions.columns import first_match


def smooth_attack_flag(windows: DataFrame, cfg: WindowConfig = WindowConfig(), keys=("day",)) -> DataFrame:
    """Attack rule per window, then a majority vote over the rows around it."""
    raw = ((F.col("attack_flows") >= cfg.min_attack_flows) & (F.col("attack_ratio") >= cfg.min_attack_ratio)).cast("int")
    if cfg.smooth_radius <= 0:
        return windows.withColumn("is_attack", raw)
    around = W.partitionBy(*keys).orderBy("window_index").rowsBetween(-cfg.smooth_radius, cfg.smooth_radius)
    return windows.withColumn("is_attack", (F.avg(raw).over(around) >= 0.5).cast("int"))


def episodes_of(windows: DataFrame, flag: str = "is_attack", keys=("day",)) -> DataFrame:
    """Add ``episode``: running number of the run of attack rows (row neighbours); NULL off attack."""
    order = W.partitionBy(*keys).orderBy("window_index")
    starts = (F.col(flag) == 1) & (F.coalesce(F.lag(flag).over(order), F.lit(0)) == 0)
    numbered = windows.withColumn("_start", starts.cast("int"))
    return numbered.withColumn("episode", F.when(F.col(flag) == 1, F.sum("_start").over(order))).drop("_start")


def progression_states(windows: DataFrame, cfg: WindowConfig = WindowConfig(), keys=("day",)) -> DataFrame:
    """``is_attack``, ``progression_state``, ``progression_idx`` and ``y_attack`` for every window."""
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("window_index")
    rows = episodes_of(smooth_attack_flag(windows, cfg, keys), "is_attack", keys)

    # a benign row k rows before an onset, with consecutive indices all the way
    ahead = []
    for k in range(1, cfg.pre_attack_span + 1):
        quiet = [F.lead("is_attack", j).over(order) == 0 for j in range(1, k)]
        ahead.append(reduce(lambda a, b: a & b, quiet, F.lead("is_attack", k).over(order) == 1)
                     & (F.lead("window_index", k).over(order) - F.col("window_index") == k))
    before_onset = (F.col("is_attack") == 0) & F.coalesce(reduce(lambda a, b: a | b, ahead), F.lit(False))

    run = W.partitionBy(*keys, "is_attack", "episode").orderBy("window_index")
    whole = W.partitionBy(*keys, "is_attack", "episode")
    named = F.when(F.col("dominant_family") != BENIGN, F.col("dominant_family"))
    rows = rows.withColumns({
        "_pre": before_onset,
    }).withColumns({
        "_pos": F.row_number().over(run),
        "_len": F.count(F.lit(1)).over(whole),
        "_peak": F.max("attack_ratio").over(whole),
        "_prev": F.coalesce(
            F.last(named, ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(BENIGN)),
    })
    attack = F.col("is_attack") == 1
    tail = (F.col("_pos") > 1) & (F.col("_pos") == F.col("_len")) & (F.col("attack_ratio") < F.col("_peak") * 0.5)
    changed = (F.col("dominant_family") != BENIGN) & (F.col("dominant_family") != F.col("_prev"))
    state = first_match([
        (attack & (F.col("_pos") == 1), "ONSET"),
        (attack & (tail | changed), "CONTINUATION"),
        (attack, "ACTIVE"),
        (F.col("_pre"), "PRE_ATTACK"),
    ], "NORMAL")
    rows = rows.withColumn("progression_state", state)
    return rows.withColumns({
        "progression_idx": first_match([(F.col("progression_state") == s, i) for i, s in enumerate(STATES)], 0),
        "y_attack": F.col("progression_state").isin(*ATTACK_STATES).cast("int"),
    }).drop("_pre", "_pos", "_len", "_peak", "_prev", "episode")


def progression_now(windows: DataFrame, cfg: WindowConfig = WindowConfig(), keys=("day",)) -> DataFrame:
    """Progression state of each window as it was known when it closed: no later window has a say.

    The last window's majority vote has only rows before it, the windows before it have theirs whole, and nothing is
    PRE_ATTACK yet. Votes reach one row at most.
    """
    if cfg.smooth_radius not in (0, 1):
        raise ValueError("states of the newest window need a vote of radius 0 or 1")
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("window_index")
    raw = ((F.col("attack_flows") >= cfg.min_attack_flows) & (F.col("attack_ratio") >= cfg.min_attack_ratio)).cast("int")
    rows = episodes_of(smooth_attack_flag(windows, cfg, keys), "is_attack", keys)
    run = W.partitionBy(*keys, "is_attack", "episode").orderBy("window_index").rowsBetween(W.unboundedPreceding, 0)
    named = F.when(F.col("dominant_family") != BENIGN, F.col("dominant_family"))
    rows = rows.withColumns({"_top": F.max("attack_ratio").over(run), "_fam": F.last(named, ignorenulls=True).over(run)})
    going = F.coalesce(F.lag("is_attack").over(order), F.lit(0)) == 1
    rows = rows.withColumns({
        "_now": (F.avg(raw).over(order.rowsBetween(-cfg.smooth_radius, 0)) >= 0.5), "_going": going,
        "_peak": F.greatest(F.lag("_top").over(order), F.col("attack_ratio")), "_prev": F.coalesce(F.lag("_fam").over(order), F.lit(BENIGN))})
    changed = (F.col("dominant_family") != BENIGN) & (F.col("dominant_family") != F.col("_prev"))
    state = first_match([
        (~F.col("_now"), "NORMAL"), (~F.col("_going"), "ONSET"),
        ((F.col("attack_ratio") < F.col("_peak") * 0.5) | changed, "CONTINUATION")], "ACTIVE")
    return rows.withColumn("progression_state", state).drop("is_attack", "episode", "_top", "_fam", "_now", "_going", "_peak", "_prev")
