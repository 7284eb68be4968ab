"""Anchor forecasts: persistence, lead-k state table, blending, alerts and family guess."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import ATTACK_STATES, BENIGN, STATES, AlertConfig, SequenceConfig, WindowConfig
from tidewatch.functions.columns import first_match
from tidewatch.functions.grouped import exact_quantiles

# Weights of the family scores; churn, focus and fan are sums used by several families.
CHURN = ("failed_conn_ratio", "rst_rate", "fin_rate")
FAMILY_WEIGHTS = {
    "PortScan": {"unique_dst_ports_per_src": 0.9, "unique_dst_ports": 1.0, "port_scan_entropy": 1.0,
                 "port_scan_seq_ratio": 0.8, "syn_rate": 0.8, "fan": 0.6, "byte_count": -0.6, "flow_duration_mean": -0.5},
    "DoS Hulk": {"flow_count": 1.0, "d_packet_rate": 0.9, "d_byte_rate": 0.9, "churn": 0.9, "focus": 1.0,
                 "packet_rate": 0.5, "unique_dst_ports": -0.5},
    "SSH-Patator": {"churn": 1.0, "focus": 0.8, "failed_conn_ratio": 0.6, "unique_dst_ports": -0.9,
                    "flow_count": -0.8, "byte_count": -0.6, "d_byte_rate": -0.5},
    "Infiltration": {"byte_count": 1.2, "fwd_bwd_ratio": 1.0, "d_byte_rate": 0.8, "flow_duration_mean": 0.7,
                     "flow_count": -1.0, "packet_rate": -0.8, "churn": -0.6},
    "Bot": {"udp_ratio": 0.8, "time_since_prev_window": 0.7, "flow_count": -0.9, "byte_count": -0.8,
            "churn": -0.6, "unique_dst": -0.5},
}
MIN_TOP, MIN_MARGIN, SURE_TOP, SURE_MARGIN = 7.0, 2.5, 12.0, 5.0


def alert_columns(probs: Column, horizon: int, seconds: float, threshold: float) -> dict[str, Column]:
    """First step at or over the threshold, alert flag, lead and maximum of a probability array."""
    step = F.array_position(F.transform(probs, lambda p: p >= threshold), F.lit(True)).cast("int")
    hit = F.coalesce(step, F.lit(0)) > 0
    return {
        "first_alert_k": F.when(hit, step),
        "alert": hit,
        "lead_time_seconds": F.when(hit, (F.lit(horizon + 1) - step) * F.lit(float(seconds))).otherwise(F.lit(0.0)),
        "max_attack_prob": F.array_max(probs),
    }


def persistence(anchors: DataFrame, horizon: int, now: str = "y_now") -> DataFrame:
    return anchors.withColumn("attack_prob", F.array_repeat(F.col(now).cast("double"), horizon))


def transition_table(windows: DataFrame, horizon: int, keys=("day",)) -> DataFrame:
    """P(state at t+k | state at t) for k = 1..horizon over train windows with consecutive indices."""
    order = W.partitionBy(*keys).orderBy("window_index")
    steps = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lead("progression_state", k).over(order).alias("next"),
                 (F.lead("window_index", k).over(order) - F.col("window_index")).alias("gap"),
                 F.lead("split", k).over(order).alias("split")) for k in range(1, horizon + 1)])
    rows = windows.withColumn("_s", steps).where(F.col("split") == "train").select(
        F.col("progression_state").alias("state"), F.explode("_s").alias("s"))
    counts = rows.where((F.col("s.gap") == F.col("s.k")) & (F.col("s.split") == "train")).groupBy(
        "state", F.col("s.k").alias("k"), F.col("s.next").alias("next")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("state", "k"))
    return counts.select("state", "k", "next", share.alias("prob"))


def state_forecast(anchors: DataFrame, table: DataFrame, horizon: int) -> DataFrame:
    """Rows (anchor, k) with the state distribution, its top state and P(attack).

    The table has at most 5 states x horizon x 5 rows, so it is broadcast. A state
    never seen in training keeps its own state with probability 1.
    """
    spread = table.groupBy("state", "k").agg(*[
        F.coalesce(F.sum(F.when(F.col("next") == s, F.col("prob"))), F.lit(0.0)).alias(f"p_{s}") for s in STATES])
    steps = anchors.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    joined = steps.join(F.broadcast(spread), (F.col("progression_state") == F.col("state")) & (steps["k"] == spread["k"]), "left")
    dist = {s: F.coalesce(F.col(f"p_{s}"), (F.col("progression_state") == s).cast("double")) for s in STATES}
    top = F.array_max(F.array(*[F.struct(dist[s].alias("p"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, s in enumerate(STATES)]))
    return joined.select(
        *[anchors[c] for c in anchors.columns], steps["k"],
        F.create_map(*[x for s in STATES for x in (F.lit(s), dist[s])]).alias("progression_dist"),
        top["s"].alias("forecast_state"), top["p"].alias("state_prob"),
        reduce(lambda a, b: a + b, [dist[s] for s in ATTACK_STATES]).alias("attack_prob"))


def nest_horizon(steps: DataFrame, anchor: list[str], fields: list[str]) -> DataFrame:
    """(anchor, k) rows -> one row per anchor with ``horizon`` ordered by k (horizon length is fixed)."""
    return steps.groupBy(*anchor).agg(F.array_sort(F.collect_list(F.struct("k", *fields))).alias("horizon"))


def draw_summary(draws: DataFrame, anchor: list[str], prob: str = "prob", dist: str | None = None) -> DataFrame:
    """Mean, 2.5 / 97.5 percentile and population deviation of the draws of each (anchor, k).

    With ``dist``, an array column with a probability per state, also ``state_dist``, its mean by position over the draws, and the most
    likely state of that with its probability. Positions are averaged side by side, so no draw is repeated per state; the percentiles
    are located by counts in two levels, so no group's draws are ever held together.
    """
    by = [*anchor, "k"]
    means = [F.avg(F.get(dist, F.lit(i))).alias(f"_s{i}") for i in range(len(STATES))] if dist else []
    one = draws.groupBy(*by).agg(F.avg(prob).alias("attack_prob"), F.stddev_pop(prob).alias("attack_std"), *means)
    q = exact_quantiles(draws, by, prob, [0.025, 0.975])
    ends = q.groupBy(*by).agg(
        F.max(F.when(F.col("p") == 0.025, F.col("q"))).alias("attack_ci_lo"), F.max(F.when(F.col("p") == 0.975, F.col("q"))).alias("attack_ci_hi"))
    out = one.join(ends, by)
    if not dist:
        return out
    names = [f"_s{i}" for i in range(len(STATES))]
    top = F.array_max(F.array(*[F.struct(F.col(n).alias("p"), F.lit(-i).alias("o"), F.lit(s).alias("s")) for i, (n, s) in enumerate(zip(names, STATES))]))
    return out.withColumns({"state_dist": F.array(*names), "progression_state": top["s"], "state_prob": top["p"]}).drop(*names)


def blend(base: DataFrame, members: DataFrame, anchor: list[str], weight: float) -> DataFrame:
    """``weight`` * base + (1 - weight) * mean of the member scores per (anchor, k)."""
    mean = members.groupBy(*anchor, "k").agg(F.avg("attack_prob").alias("_m"))
    joined = base.join(mean, [*anchor, "k"], "left")
    mixed = F.col("attack_prob") * weight + F.col("_m") * (1.0 - weight)
    return joined.withColumn("detection_prob", F.coalesce(mixed, F.col("attack_prob"))).drop("_m")


def anchors_with_alert(nested: DataFrame, cfg: AlertConfig = AlertConfig(), seq: SequenceConfig = SequenceConfig(),
                       window: WindowConfig = WindowConfig(), prob: str = "attack_prob") -> DataFrame:
    probs = F.transform("horizon", lambda h: h[prob])
    return nested.withColumns(alert_columns(probs, seq.horizon, window.window_seconds, cfg.threshold))


def guess_family(rows: DataFrame, value) -> DataFrame:
    """Family guess from scaled features: ``guess`` and ``guess_confidence``.

    ``value(name)`` gives the Column of a feature (a 0 literal where it is absent).
    """
    churn = value(CHURN[0]) + value(CHURN[1]) + value(CHURN[2])
    groups = {
        "churn": churn,
        "focus": -value("dstip_entropy") - value("unique_dst"),
        "fan": value("unique_dst") + value("dstip_entropy") + value("fan_out"),
    }
    scores = []
    for i, (family, weights) in enumerate(FAMILY_WEIGHTS.items()):
        terms = [F.lit(w) * (groups[n] if n in groups else value(n)) for n, w in weights.items()]
        scores.append(F.struct(reduce(lambda a, b: a + b, terms).alias("s"), F.lit(-i).alias("o"), F.lit(family).alias("f")))
    rows = rows.withColumn("_s", F.sort_array(F.array(*scores), asc=False))
    top, margin = F.col("_s")[0]["s"], F.col("_s")[0]["s"] - F.col("_s")[1]["s"]
    clear = (top >= MIN_TOP) & (margin >= MIN_MARGIN)
    return rows.withColumns({
        "guess": F.when(clear, F.col("_s")[0]["f"]).otherwise(BENIGN),
        "guess_confidence": F.when(clear & (margin >= SURE_MARGIN) & (top >= SURE_TOP), "Medium").otherwise("Low"),
    }).drop("_s")


def choose_family(rows: DataFrame, hint: str | None = None) -> DataFrame:
    """Explicit hint, else a Medium guess, else benign; a weaker guess stays advisory."""
    explicit = bool(hint) and hint.upper() != BENIGN
    sure = (F.col("guess") != BENIGN) & (F.col("guess_confidence") == "Medium")
    chosen = {"family": F.lit(hint), "family_inferred": F.lit(False)} if explicit else {
        "family": F.when(sure, F.col("guess")).otherwise(BENIGN), "family_inferred": sure}
    rows = rows.withColumns(chosen)
    advise = (F.col("guess") != BENIGN) & ~F.col("family_inferred") & (F.col("family") == BENIGN)
    return rows.withColumns({
        "possible_family": F.when(advise, F.col("guess")),
        "possible_family_confidence": F.when(advise, F.col("guess_confidence"))})


def peak_step(anchors: DataFrame, prob: str = "attack_prob") -> DataFrame:
    """Step with the highest probability of each anchor (the earlier one on ties)."""
    ranked = F.array_max(F.transform("horizon", lambda h: F.struct(h[prob].alias("p"), (-h["k"]).alias("o"))))
    return anchors.withColumns({"peak_prob": ranked["p"], "peak_k": -ranked["o"]})


def alerting_or_all(anchors: DataFrame) -> DataFrame:
    """Alerting anchors when there are any, else every anchor."""
    any_alert = anchors.where("alert").select(F.lit(1)).take(1)
    return anchors.where("alert") if any_alert else anchors


def showcase(anchors: DataFrame, order: list[str], attacks: int = 6, quiet: int = 2) -> DataFrame:
    """Attack anchors with the highest probability and the first quiet ones."""
    hot = anchors.where(F.col("y_now") == 1).orderBy(F.desc("max_attack_prob"), *order).limit(attacks)
    calm = anchors.where(~F.col("alert")).orderBy(*order).limit(quiet)
    return hot.withColumn("kind", F.lit("attack")).unionByName(calm.withColumn("kind", F.lit("quiet")))


def top_state(dist: Column) -> Column:
    """Most likely state of a state -> probability map (the earlier state on ties)."""
    entries = F.transform(F.map_entries(dist), lambda e: F.struct(
        e["value"].alias("p"), (-first_match([(e["key"] == s, i) for i, s in enumerate(STATES)], 9)).alias("o"), e["key"].alias("s")))
    return F.array_max(entries)["s"]


def horizon_report(anchors: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    """One flat row per (anchor, k)."""
    return anchors.select(*keep, F.explode("horizon").alias("h")).select(*keep, "h.k", *[F.col(f"h.{f}").alias(f) for f in fields])


def forecast_summary(anchors: DataFrame, prob: str = "attack_prob") -> DataFrame:
    """Alerts, highest probability and distinct phases except the unspecific ones."""
    phases = F.filter(F.transform("horizon", lambda h: h["attck_phase"]), lambda p: ~p.isin("None", "Attack (unspecified)"))
    one = anchors.withColumn("_p", F.explode_outer(F.array_distinct(phases)))
    # exploding repeats an anchor, so the counters come from a second, unexploded pass over the same rows
    names = one.where("_p is not null").groupBy("_p").agg(F.count(F.lit(1)).alias("_n")).agg(
        F.array_sort(F.collect_list("_p")).alias("phases"))
    counts = anchors.agg(F.count(F.lit(1)).alias("n_anchors"), F.sum(F.col("alert").cast("long")).alias("n_alerts"),
                         F.round(F.max("max_attack_prob"), 4).alias("max_attack_prob"))
    stacked = counts.unionByName(names, allowMissingColumns=True)
    return stacked.agg(F.max("n_anchors").alias("n_anchors"), F.max("n_alerts").alias("n_alerts"),
                       F.max("max_attack_prob").alias("max_attack_prob"), F.max("phases").alias("phases"))


def kpis(anchors: DataFrame) -> DataFrame:
    """Dashboard figures; a quiet anchor has lead 0, so one quiet anchor makes the earliest lead 0."""
    peak = F.coalesce(F.col("max_detection_prob"), F.col("max_attack_prob")) if "max_detection_prob" in anchors.columns else F.col("max_attack_prob")
    lead = F.when(F.col("lead_time_seconds") >= 0, F.col("lead_time_seconds"))
    return anchors.agg(
        F.sum(F.col("alert").cast("long")).alias("alerts"), F.count(F.lit(1)).alias("anchors"),
        F.coalesce(F.max(peak), F.lit(0.0)).alias("peak_prob"), F.min(lead).alias("earliest_lead_seconds"))


def anchor_families(anchors: DataFrame, windows: DataFrame, keys=("day",)) -> DataFrame:
    """Family of the anchor's own window; an unknown window gives ``?``."""
    on = [*keys, "window_index"]
    joined = anchors.join(windows.select(*on, F.col("dominant_family").alias("family")), on, "left")
    return joined.withColumn("family", F.coalesce("family", F.lit("?")))


def simulate_split(anchors: DataFrame, split: str, prob: str = "attack_prob") -> DataFrame:
    """Peak step of the alerting anchors of one split (of all its anchors when none alerts)."""
    return peak_step(alerting_or_all(anchors.where(F.col("split") == split)), prob)
