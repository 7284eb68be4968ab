"""Train-only data generation: synthetic attack episodes at flow grain, and sequence augmentation.

Every draw is a hash of the seed and the row's keys, so a rerun of a lost task
gives the same rows and the result does not depend on the partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import AugmentConfig, SequenceConfig, WindowConfig
from tidewatch.functions.columns import unit_draw
from tidewatch.functions.grouped import hash_rank
from tidewatch.operators.windows import TIME, origins
from tidewatch.session import durable, stored

# Families never augmented, and columns scaled by the timing jitter.
UNLEARNABLE = ("Heartbleed", "Infiltration", "Web Attack SQL Injection")
JITTER_COLUMNS = (
    "flow_duration", "flow_iat_mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
)
DROPOUT_SHARE, PORTS_SHARE = 0.6, 0.7
GAP_WINDOWS = 120.0


def flow_split_labels(flows: DataFrame, windows: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Flows with ``_wi`` and ``_split`` of their window; a window without a split trains."""
    start = flows.join(stored(origins(flows, ["day"]), "origins"), ["day"])
    rows = start.withColumn("_wi", F.floor((F.col(TIME) - F.col("t0")) / cfg.window_seconds)).drop("t0")
    labels = windows.select("day", F.col("window_index").alias("_wi"), F.col("split").alias("_split"))
    joined = rows.join(labels, ["day", "_wi"], "left")
    return joined.withColumn("_split", F.coalesce("_split", F.lit("train")))


def bridged_runs(indices: DataFrame, keys: list[str], index: str, gap: int) -> DataFrame:
    """Runs of indices that bridge up to ``gap`` missing ones: (keys, run, start, end)."""
    order = W.partitionBy(*keys).orderBy(index)
    new = F.coalesce(F.col(index) - F.lag(index).over(order) > gap + 1, F.lit(True))
    rows = indices.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(order))
    return rows.groupBy(*keys, "run").agg(F.min(index).alias("start"), F.max(index).alias("end"))


def variant_plan(labelled: DataFrame, cfg: AugmentConfig, seq: SequenceConfig, window: WindowConfig) -> DataFrame:
    """Episodes x variants to build, in round-robin order until the cap on positive windows is reached.

    Everything here is window grain or smaller.
    """
    attacks = labelled.where((F.col("_split") == "train") & (F.col("is_attack") == 1))
    fams = list(cfg.families)
    chosen = F.col("attack_family").isin(*fams) if fams else ~F.col("attack_family").isin(*UNLEARNABLE)
    positive = durable(attacks.groupBy("day", "attack_family", "_wi").agg(F.count(F.lit(1)).alias("n")))
    cap = int(cfg.cap_fraction * positive.count()) if cfg.cap_fraction else 0
    runs = bridged_runs(positive.where(chosen), ["day", "attack_family"], "_wi", window.episode_gap_windows)
    size = positive.groupBy("day", "attack_family").agg(F.count(F.lit(1)).alias("_windows"))
    runs = runs.join(size, ["day", "attack_family"]).withColumn("rare", F.col("_windows") < cfg.rare_below_windows)
    runs = runs.withColumns({"lo": F.col("start") - (seq.history + 3), "hi": F.col("end") + (seq.horizon + 3)})
    # own attack flows (of any split) inside the context have to be at least two
    own = labelled.where(F.col("is_attack") == 1).groupBy("day", "attack_family", "_wi").agg(F.count(F.lit(1)).alias("n"))
    cells = runs.withColumn("_wi", F.explode(F.sequence("lo", "hi"))).join(own, ["day", "attack_family", "_wi"])
    enough = cells.groupBy("day", "attack_family", "run").agg(F.sum("n").alias("own")).where(F.col("own") >= 2)
    plan = runs.join(enough, ["day", "attack_family", "run"])
    plan = plan.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(cfg.max_variants - 1))))
    plan = plan.withColumn("windows", F.col("end") - F.col("start") + 1)
    # running sum in (variant, family, day, run) order, in two levels: blocks, then inside a block
    block = ["v", "attack_family", "day"]
    blocks = plan.groupBy(*block).agg(F.sum("windows").alias("_b"))
    blocks = blocks.withColumn("_before", F.sum("_b").over(W.orderBy(*block)) - F.col("_b")).drop("_b")
    inside = F.sum("windows").over(W.partitionBy(*block).orderBy("run")) - F.col("windows")
    plan = plan.withColumn("_in", inside).join(blocks, block).withColumn("built_before", F.col("_before") + F.col("_in"))
    plan = plan.where(F.col("built_before") < cap) if cap else plan
    key = [F.col(c) for c in ("day", "attack_family", "run", "v")]
    return plan.withColumns({
        "plan_id": F.concat_ws("|", *[c.cast("string") for c in key]),
        "tempo": F.lit(1.0) + (unit_draw(cfg.seed, F.lit("tempo"), *key) * 2.0 - 1.0) * cfg.jitter,
        "drops": unit_draw(cfg.seed, F.lit("drops"), *key) < DROPOUT_SHARE,
        "shuffles": (unit_draw(cfg.seed, F.lit("ports"), *key) < PORTS_SHARE) & F.lit(cfg.port_shuffle),
    }).drop("_before", "_in", "_windows")


def _context(labelled: DataFrame, plan: DataFrame) -> DataFrame:
    """Flows of the episode windows with their margins: the range becomes an equi join on window numbers."""
    cells = plan.select("day", "plan_id", F.col("attack_family").alias("fam"), "tempo", "drops", "shuffles", "v",
                        F.explode(F.sequence("lo", "hi")).alias("_wi"))
    rows = labelled.join(cells, ["day", "_wi"])
    return rows.where((F.col("is_attack") == 0) | (F.col("attack_family") == F.col("fam")))


def _jitter(rows: DataFrame, cfg: AugmentConfig) -> DataFrame:
    attack = F.col("is_attack") == 1
    out = {}
    for c in JITTER_COLUMNS:
        if c in rows.columns:
            factor = F.lit(1.0) + (unit_draw(cfg.seed, F.lit(c), F.col("plan_id"), F.col("flow_id")) * 2.0 - 1.0) * cfg.jitter
            col = F.col(f"`{c}`")
            out[c] = F.when(attack, F.greatest(col * factor, F.lit(0.0))).otherwise(col)
    return rows.withColumns(out)


def _shuffle_ports(rows: DataFrame, cfg: AugmentConfig) -> DataFrame:
    """One permutation of the attack ports per variant: natural rank against hash rank (at most 65,536 ports)."""
    ports = rows.where((F.col("is_attack") == 1) & F.col("shuffles")).select("plan_id", "dst_port").distinct()
    by = W.partitionBy("plan_id")
    natural = ports.withColumn("r", F.row_number().over(by.orderBy("dst_port")))
    drawn = ports.withColumn("_u", unit_draw(cfg.seed, F.lit("perm"), F.col("plan_id"), F.col("dst_port")))
    drawn = drawn.withColumn("r", F.row_number().over(by.orderBy("_u", "dst_port"))).select(
        "plan_id", "r", F.greatest(F.least(F.col("dst_port"), F.lit(65535)), F.lit(1)).alias("new_port"))
    mapping = natural.join(drawn, ["plan_id", "r"]).drop("r")
    joined = rows.join(mapping, ["plan_id", "dst_port"], "left")
    new = F.when((F.col("is_attack") == 1) & F.col("new_port").isNotNull(), F.col("new_port")).otherwise(F.col("dst_port"))
    return joined.withColumn("dst_port", new.cast(dict(rows.dtypes)["dst_port"])).drop("new_port")


def _drop_flows(rows: DataFrame, cfg: AugmentConfig) -> DataFrame:
    """Drop a fixed share of the attack flows of a variant, keeping at least two."""
    attack = rows.where((F.col("is_attack") == 1) & F.col("drops"))
    ranked = hash_rank(attack, ["plan_id"], unit_draw(cfg.seed, F.lit("drop"), F.col("plan_id"), F.col("flow_id")), ["flow_id"], "_r")
    gone = F.least(F.bround(F.col("_r_of") * cfg.dropout).cast("long"), F.col("_r_of") - 2)
    kept = ranked.where(F.col("_r") >= gone).drop("_r", "_r_of")
    return rows.where((F.col("is_attack") == 0) | ~F.col("drops")).unionByName(kept)


def benign_stretches(labelled: DataFrame, need: int) -> DataFrame:
    """Runs of consecutive train windows without attack flows that hold at least ``need`` windows."""
    per = labelled.where(F.col("_split") == "train").groupBy("day", "_wi").agg(F.max("is_attack").alias("a"))
    runs = bridged_runs(per.where(F.col("a") == 0), ["day"], "_wi", 0)
    return runs.where(F.col("end") - F.col("start") + 1 >= need)


def pad_places(labelled: DataFrame, need: int) -> DataFrame:
    """Benign stretches with ``_places``, the starts that leave room for ``need`` windows, numbered from ``_from`` by day and start.

    Window grain: counted per day first, then shifted by the days before.
    """
    rows = benign_stretches(labelled, need).withColumn("_places", F.col("end") - F.col("start") + 2 - need)
    days = rows.groupBy("day").agg(F.sum("_places").alias("_n"))
    days = days.withColumn("_before", F.sum("_n").over(W.orderBy("day")) - F.col("_n")).drop("_n")
    inside = F.sum("_places").over(W.partitionBy("day").orderBy("start")) - F.col("_places")
    return rows.withColumn("_in", inside).join(days, "day").withColumn("_from", F.col("_before") + F.col("_in")).drop("_in", "_before")


def _pads(labelled: DataFrame, plan: DataFrame, cfg: AugmentConfig, need: int) -> DataFrame:
    """Benign flows of another day for the odd variants of rare families, rebased to 0.

    Every variant draws anew among all places of other days where a pad fits, so that variants differ in day and start.
    """
    wanted = plan.where(F.col("rare") & (F.col("v") % 2 == 1))
    stretches = durable(pad_places(labelled, need))
    days = stretches.groupBy("day").agg(F.min("_from").alias("_from"), F.sum("_places").alias("_own"))
    total = stretches.agg(F.sum("_places")).first()[0] or 0
    # number of the place among those of all other days: the own day's numbers are skipped
    drawn = wanted.join(days, "day", "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    number = F.floor(unit_draw(cfg.seed, F.lit("pad"), F.col("plan_id")) * (F.lit(total) - F.col("_own")))
    drawn = drawn.where(F.col("_own") < total).withColumn("_no", number)
    drawn = drawn.withColumn("_no", F.col("_no") + F.when(F.col("_no") >= F.col("_from"), F.col("_own")).otherwise(0))
    numbered = stretches.select(F.col("day").alias("_day"), "start", F.posexplode(F.sequence(F.lit(1), "_places")).alias("_at", "_"), "_from").select(
        "_day", (F.col("_from") + F.col("_at")).alias("_no"), (F.col("start") + F.col("_at")).alias("_f"))
    picked = drawn.select("plan_id", F.col("attack_family").alias("fam"), "_no").join(numbered, "_no")
    cells = picked.select("plan_id", "fam", F.col("_day").alias("day"), F.explode(F.sequence(F.col("_f"), F.col("_f") + need - 1)).alias("_wi"))
    return labelled.join(cells, ["day", "_wi"])


def augment_flows(flows: DataFrame, windows: DataFrame, cfg: AugmentConfig = AugmentConfig(), seq: SequenceConfig = SequenceConfig(),
                  window: WindowConfig = WindowConfig()) -> DataFrame:
    """Real flows plus synthetic episodes on ``__aug_<family>__`` days, marked ``is_synthetic`` = 1.

    ``windows`` carries day, window_index and split. Validation and test rows are
    never touched: only train windows start an episode or give a benign stretch.
    """
    real = flows if "is_synthetic" in flows.columns else flows.withColumn("is_synthetic", F.lit(0))
    labelled = flow_split_labels(real.where(F.col("is_synthetic") == 0), windows, window)
    plan = durable(variant_plan(labelled, cfg, seq, window))
    rows = _drop_flows(_shuffle_ports(_jitter(_context(labelled, plan), cfg), cfg), cfg)
    keep = [c for c in real.columns]
    body = rows.select("plan_id", "fam", "tempo", *keep)
    first = body.groupBy("plan_id").agg(F.min(TIME).alias("_t0"))
    body = body.join(first, ["plan_id"]).withColumn(TIME, (F.col(TIME) - F.col("_t0")) * F.col("tempo"))
    body = body.withColumn("_part", F.lit(1)).drop("tempo", "_t0")
    if cfg.transplant:
        pad = _pads(labelled, plan, cfg, seq.history + 3).select("plan_id", "fam", *keep)
        start = pad.groupBy("plan_id").agg(F.min(TIME).alias("_t0"))
        pad = pad.join(start, ["plan_id"]).withColumn(TIME, F.col(TIME) - F.col("_t0")).drop("_t0")
        body = body.unionByName(pad.withColumn("_part", F.lit(0)))
    body = durable(body)
    # one row per variant: where it starts on its family's day
    ends = body.groupBy("plan_id", "fam").agg(
        F.max(F.when(F.col("_part") == 0, F.col(TIME))).alias("_pad"), F.max(F.when(F.col("_part") == 1, F.col(TIME))).alias("_len"))
    shift = F.coalesce(F.col("_pad") + window.window_seconds, F.lit(0.0))
    ends = ends.join(plan.select("plan_id", "built_before"), "plan_id").withColumn("_shift", shift)
    span = F.col("_len") + F.col("_shift") + GAP_WINDOWS * window.window_seconds
    order = W.partitionBy("fam").orderBy("built_before", "plan_id")
    ends = ends.withColumn("_base", F.sum(span).over(order) - span).select("plan_id", "_shift", "_base")
    placed = body.join(ends, ["plan_id"])
    made = F.concat(F.lit("__aug_"), F.col("fam"), F.lit("__"))
    placed = placed.withColumns({
        TIME: F.col(TIME) + F.col("_base") + F.when(F.col("_part") == 1, F.col("_shift")).otherwise(0.0),
        "day": made, "is_synthetic": F.lit(1).cast(dict(real.dtypes)["is_synthetic"])})
    return real.unionByName(placed.select(*keep))


# ---- sequences ---------------------------------------------------------------


@dataclass(frozen=True)
class SequenceAugment:
    p_jitter: float = 0.6
    jitter_scale: float = 0.10
    p_mixup: float = 0.4
    mixup_alpha: float = 0.4
    p_dropout: float = 0.3
    dropout_max: int = 2
    p_roll: float = 0.3
    roll_max: int = 1
    seed: int = 1337


def _beta(alpha: float, *draw_key) -> Column:
    """Symmetric Beta draw for ``alpha`` up to 1: the first accepted of 32 pairs of powered uniforms (half or more are accepted)."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError("mixup_alpha has to lie in (0, 1]")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(
        F.pow(unit_draw(*draw_key, F.lit("a"), i), F.lit(1.0 / alpha)).alias("x"),
        F.pow(unit_draw(*draw_key, F.lit("b"), i), F.lit(1.0 / alpha)).alias("y")))
    ok = F.get(F.filter(pairs, lambda p: (p["x"] + p["y"] <= 1.0) & (p["x"] + p["y"] > 0.0)), F.lit(0))
    return F.coalesce(ok["x"] / (ok["x"] + ok["y"]), F.lit(0.5))


def _normal(*draw_key) -> Column:
    u = F.greatest(unit_draw(*draw_key, F.lit("u")), F.lit(1e-12))
    return F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(unit_draw(*draw_key, F.lit("w")) * (2.0 * math.pi))


def mixup_partners(train: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """All positive sequences, numbered from 0 in the order of a draw."""
    positive = train.where(F.array_max("y_atk") > 0).select(*keys, F.struct("x", "y_atk", "y_prog").alias("_mate"))
    ranked = hash_rank(positive, [], unit_draw(seed, F.lit("partner"), *[F.col(k) for k in keys]), keys, "_mate_no")
    return ranked.select("_mate_no", "_mate")


def augment_sequences(train: DataFrame, keys: list[str], cfg: SequenceAugment = SequenceAugment(), draw: int = 0) -> DataFrame:
    """Mixup, feature jitter, window dropout and a small time roll of train sequences.

    ``draw`` numbers the pass, so each epoch sees other values. Any positive sequence
    can be the partner: its number is drawn and joined.
    """
    me = [F.col(k) for k in keys]

    def u(*what):
        return unit_draw(cfg.seed, F.lit(draw), *what, *me)

    mates = mixup_partners(train, keys, cfg.seed)
    n = train.where(F.array_max("y_atk") > 0).count()
    rows = train.withColumn("_mate_no", F.floor(u(F.lit("mate")) * n).cast("bigint")).join(mates, "_mate_no", "left")
    mix = (F.array_max("y_atk") > 0) & (u(F.lit("mix")) < cfg.p_mixup) & F.col("_mate").isNotNull()
    beta = _beta(cfg.mixup_alpha, cfg.seed, F.lit(draw), *me)
    rows = rows.withColumns({"_mix": mix, "_lam": F.greatest(beta, 1.0 - beta)})
    lam = F.col("_lam")
    x = F.when(F.col("_mix"), F.zip_with("x", F.col("_mate.x"), lambda a, b: F.zip_with(a, b, lambda p, q: p * lam + q * (1.0 - lam)))).otherwise(F.col("x"))
    atk = F.when(F.col("_mix"), F.zip_with("y_atk", F.col("_mate.y_atk"), lambda a, b: F.greatest(a, b))).otherwise(F.col("y_atk"))
    rows = rows.withColumns({"x": x, "y_atk": atk})
    both = F.zip_with("y_prog", F.col("_mate.y_prog"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    prog = F.zip_with(both, F.col("y_atk"), lambda p, a: F.when(a > 0, F.greatest(p["a"], p["b"])).otherwise(p["a"]))
    rows = rows.withColumn("y_prog", F.when(F.col("_mix") & (lam < 0.75), prog).otherwise(F.col("y_prog")))

    sigma = train.select(F.explode("x").alias("v")).select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(
        F.greatest(F.stddev_pop("v"), F.lit(1e-3)).alias("s"))
    scale = F.array(*[F.lit(r["s"] * cfg.jitter_scale) for r in sorted(sigma.collect(), key=lambda r: r["i"])])
    noisy = F.transform("x", lambda v, i: F.zip_with(
        F.transform(v, lambda f, j: F.struct(f.alias("f"), _normal(cfg.seed, F.lit(draw), F.lit("noise"), i, j, *me).alias("z"))),
        scale, lambda p, s: p["f"] + p["z"] * s))
    rows = rows.withColumn("x", F.when(u(F.lit("jitter")) < cfg.p_jitter, noisy).otherwise(F.col("x")))

    # window dropout: a window repeats the one before it and its time step becomes 0
    size = F.size("x")
    times = F.floor(u(F.lit("times")) * cfg.dropout_max) + 1
    for turn in range(cfg.dropout_max):
        at = (F.floor(u(F.lit("at"), F.lit(turn)) * (size - 1)) + 1).cast("int")
        on = (u(F.lit("dropout")) < cfg.p_dropout) & (times > turn) & (size > 3)
        rows = rows.withColumns({"_on": on, "_at": at})
        rows = rows.withColumns({
            "x": F.transform("x", lambda v, i: F.when(F.col("_on") & (i == F.col("_at")), F.element_at("x", F.col("_at"))).otherwise(v)),
            "dt": F.transform("dt", lambda v, i: F.when(F.col("_on") & (i == F.col("_at")), F.lit(0.0)).otherwise(v))})

    # time roll by s: the history moves and the freed end repeats its neighbour
    s = (F.floor(u(F.lit("roll")) * (2 * cfg.roll_max + 1)) - cfg.roll_max).cast("int")
    rows = rows.withColumn("_s", F.when(u(F.lit("rolls")) < cfg.p_roll, s).otherwise(0))
    source = lambda i: F.greatest(F.least(i - F.col("_s"), F.size("x") - 1), F.lit(0)) + 1
    rolled = F.transform(F.sequence(F.lit(0), F.size("x") - 1), lambda i: F.element_at("x", source(i).cast("int")))
    rows = rows.withColumn("x", F.when(F.col("_s") != 0, rolled).otherwise(F.col("x")))
    return rows.drop("_mate", "_mix", "_lam", "_on", "_at", "_s")


def rebalance(train: DataFrame, keys: list[str], min_positive: float = 0.3, seed: int = 1337) -> DataFrame:
    """Repeat or drop rows so that sequences with a future attack make up ``min_positive`` of the draws.

    Each row appears floor(weight) times plus once more with the remaining chance;
    the expected size stays the number of rows. Unchanged when there are enough.
    """
    positive = (F.array_max("y_atk") > 0)
    share = train.agg(F.avg(positive.cast("double")).alias("p")).first()["p"]
    if share is None or share <= 0 or share >= min_positive:
        return train
    weight = F.when(positive, min_positive / share).otherwise((1.0 - min_positive) / (1.0 - share))
    more = unit_draw(seed, F.lit("more"), *[F.col(k) for k in keys]) < weight - F.floor(weight)
    copies = (F.floor(weight) + more.cast("int")).cast("int")
    return train.withColumn("_c", copies).where(F.col("_c") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c")
