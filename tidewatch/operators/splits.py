"""Train / val / test labels for windows. An attack episode is never torn by accident."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import BENIGN, DAY_SPLIT, SplitConfig, WindowConfig
from tidewatch.functions.columns import first_match, unit_draw


def split_episodes(windows: DataFrame, gap: int = 2, keys=("day",)) -> DataFrame:
    """Add ``episode`` (number per partition, NULL outside).

    An episode is a run of attack rows. When exactly ``gap + 1`` benign rows with
    consecutive indices separate it from the next attack row, the first of them
    still belongs to it.
    """
    order = W.partitionBy(*keys).orderBy("window_index")
    atk = F.col("y_attack") == 1
    start = atk & (F.coalesce(F.lag("y_attack").over(order), F.lit(0)) == 0)
    rows = windows.withColumn("_run", F.sum(start.cast("int")).over(order))
    if gap:
        quiet = [F.lead("y_attack", j).over(order) == 0 for j in range(1, gap + 2)]
        reach = reduce(lambda a, b: a & b, quiet) & (F.lead("y_attack", gap + 2).over(order) == 1)
        close = F.lead("window_index", gap + 1).over(order) - F.col("window_index") <= gap + 1
        rows = rows.withColumn("_ext", F.coalesce(atk & reach & close, F.lit(False)))
        tail = F.coalesce(F.lag("_ext").over(order), F.lit(False))
        rows = rows.withColumn("episode", F.when(atk | tail, F.col("_run"))).drop("_ext")
    else:
        rows = rows.withColumn("episode", F.when(atk, F.col("_run")))
    return rows.drop("_run")


def _thirds(position: Column, first, second) -> Column:
    return first_match([(position <= first, "train"), (position <= second, "val")], "test")


def _contiguous(windows: DataFrame, fractions, keys) -> Column:
    """Chronological cut by position / n within the partition."""
    share = F.cume_dist().over(W.partitionBy(*keys).orderBy("window_index"))
    return _thirds(share, F.lit(float(fractions[0])), F.lit(float(fractions[0] + fractions[1])))


def _blocks(cfg: SplitConfig, window: WindowConfig, keys) -> Column:
    per_block = max(1, int(cfg.block_minutes * 60 / window.window_seconds))
    first = F.min("window_index").over(W.partitionBy(*keys))
    block = F.floor((F.col("window_index") - first) / per_block) % len(cfg.blocks)
    return F.element_at(F.array(*[F.lit(b) for b in cfg.blocks]), (block + 1).cast("int"))


def episode_table(windows: DataFrame, keys=("day",)) -> DataFrame:
    """One row per episode: first index, rows and main family (first seen wins on equal counts)."""
    keys = list(keys)
    inside = windows.where(F.col("episode").isNotNull())
    named = F.when(~F.col("dominant_family").isin(BENIGN, "?"), F.col("dominant_family"))
    per = inside.groupBy(*keys, "episode", named.alias("fam")).agg(
        F.count(F.lit(1)).alias("n"), F.min("window_index").alias("first"))
    order = F.struct(F.col("fam").isNull().alias("none"), (-F.col("n")).alias("c"), F.col("first").alias("w"))
    return per.groupBy(*keys, "episode").agg(
        F.sum("n").alias("rows"), F.min("first").alias("start"),
        F.coalesce(F.min_by("fam", order), F.lit(BENIGN)).alias("family"))


def _short_rank(episodes: DataFrame, keys) -> DataFrame:
    """Position of each episode among its family's, in partition then time order.

    Numbered inside the partition first and shifted by the counts of the earlier
    partitions, so a family's episodes never meet in one task.
    """
    counts = episodes.groupBy("family", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn(
        "_before", F.sum("_n").over(W.partitionBy("family").orderBy(*keys)) - F.col("_n")).drop("_n")
    inside = F.row_number().over(W.partitionBy("family", *keys).orderBy("start"))
    return episodes.withColumn("_in", inside).join(before, ["family", *keys]).withColumn(
        "rank", F.col("_before") + F.col("_in") - 1).drop("_before", "_in")


def _stratified(windows: DataFrame, cfg: SplitConfig, window: WindowConfig, keys) -> DataFrame:
    rows = split_episodes(windows, window.episode_gap_windows, keys)
    backbone = _blocks(cfg, window, keys) if cfg.benign == "block" else _contiguous(rows, cfg.fractions, keys)
    episodes = episode_table(rows, keys)
    short = _short_rank(episodes.where(F.col("rows") < cfg.long_episode_windows), keys)
    turn = F.element_at(F.array(*[F.lit(s) for s in cfg.rotation]), (F.col("rank") % len(cfg.rotation) + 1).cast("int"))
    plan = episodes.select(*keys, "episode", F.col("rows").alias("_len")).join(
        short.select(*keys, "episode", turn.alias("_whole")), [*keys, "episode"], "left")
    position = F.row_number().over(W.partitionBy(*keys, "episode").orderBy("window_index")) - 1
    rows = rows.withColumns({"_base": backbone, "_pos": position}).join(plan, [*keys, "episode"], "left")
    cut1 = F.greatest(F.lit(1), F.bround(F.col("_len") * cfg.fractions[0]).cast("int"))
    cut2 = cut1 + F.greatest(F.lit(1), F.bround(F.col("_len") * cfg.fractions[1]).cast("int"))
    inner = _thirds(F.col("_pos") + 1, cut1, cut2)
    if cfg.purge_windows:
        near = [(F.col("_pos") >= c - cfg.purge_windows) & (F.col("_pos") < c) for c in (cut1, cut2)]
        inner = F.when(near[0] | near[1], "ignore").otherwise(inner)
    label = first_match([(F.col("episode").isNull(), F.col("_base")), (F.col("_whole").isNotNull(), F.col("_whole"))], inner)
    return rows.withColumn("split", label).drop("_base", "_pos", "_len", "_whole", "episode")


def _episode_chrono(windows: DataFrame, cfg: SplitConfig, window: WindowConfig, keys) -> DataFrame:
    """Each episode with 6 rows before and after is cut by index; a share of benign rows joins val and test."""
    keys = list(keys)
    order = W.partitionBy(*keys).orderBy("window_index")
    rows = split_episodes(windows, window.episode_gap_windows, keys).withColumn("_rn", F.row_number().over(order))
    f1, f2 = cfg.fractions[0], cfg.fractions[0] + cfg.fractions[1]
    spans = (
        rows.where(F.col("episode").isNotNull()).groupBy(*keys, "episode")
        .agg(F.min("_rn").alias("i"), F.max("_rn").alias("j"),
             (F.max("window_index") - F.min("window_index") + 1).alias("span"))
        .withColumn("lo", F.greatest(F.col("i") - 6, F.lit(1)))
        .select(*keys, "episode", "lo", (F.greatest(F.col("span") + F.col("i") - F.col("lo"), F.lit(1))).alias("width"),
                F.explode(F.sequence("lo", F.col("j") + 6)).alias("_rn")))
    first = rows.select(*keys, F.col("_rn").alias("lo"), F.col("window_index").alias("_w0"))
    covered = (
        spans.join(first, [*keys, "lo"]).groupBy(*keys, "_rn")
        .agg(F.max_by(F.struct("_w0", "width"), "episode").alias("_e")))
    part = (F.col("window_index") - F.col("_e._w0")) / F.col("_e.width")
    who = [F.col(k) for k in keys] + [F.col("window_index")]
    drawn = unit_draw(cfg.seed, *who) < cfg.benign_sample
    other = F.when(unit_draw(cfg.seed + 1, *who) < cfg.fractions[1] / (1 - cfg.fractions[0] + 1e-9), "val").otherwise("test")
    label = first_match([
        ((F.col("y_attack") == 0) & drawn, other), (F.col("_e").isNull(), F.lit("train"))],
        _thirds(part, F.lit(float(f1)), F.lit(float(f2))))
    return rows.join(covered, [*keys, "_rn"], "left").withColumn("split", label).drop("_e", "_rn", "episode")


def _family(windows: DataFrame, cfg: SplitConfig, keys) -> DataFrame:
    order = W.partitionBy(*keys).orderBy("window_index")
    fam = F.col("dominant_family")
    held = first_match([(fam.isin(*cfg.family_val), "val"), (fam.isin(*cfg.family_test), "test")], F.lit(None).cast("string"))
    rows = windows.withColumn("_held", held)
    before = F.last("_held", ignorenulls=True).over(order)
    back = W.partitionBy(*keys).orderBy(F.desc("window_index"))
    after = F.last("_held", ignorenulls=True).over(back)
    rows = rows.withColumn("_near", F.coalesce(before, after))
    return rows.withColumn("split", F.coalesce(
        F.when(fam == BENIGN, F.col("_near")).otherwise(F.col("_held")), F.lit("train"))).drop("_held", "_near")


def assign_split(windows: DataFrame, cfg: SplitConfig = SplitConfig(), window: WindowConfig = WindowConfig(),
                 keys=("day",)) -> DataFrame:
    """Add ``split``. Synthetic windows always train and never influence the others."""
    keys = list(keys)
    if "is_synthetic" in windows.columns:
        real = _assign(windows.where(F.col("is_synthetic") == 0), cfg, window, keys)
        made = windows.where(F.col("is_synthetic") != 0).withColumn("split", F.lit("train"))
        return real.unionByName(made)
    return _assign(windows, cfg, window, keys)


def _assign(windows, cfg, window, keys):
    mode = "stratified" if cfg.mode == "auto" else cfg.mode
    if mode == "stratified":
        return _stratified(windows, cfg, window, keys)
    if mode == "day":
        return windows.withColumn("split", first_match([(F.col("day") == d, s) for d, s in DAY_SPLIT.items()], "train"))
    if mode == "chronological":
        return windows.withColumn("split", _contiguous(windows, cfg.fractions, keys))
    if mode == "episode_chrono":
        return _episode_chrono(windows, cfg, window, keys)
    if mode == "family":
        return _family(windows, cfg, keys)
    if mode == "block":
        return windows.withColumn("split", _blocks(cfg, window, keys))
    raise ValueError(f"unknown split mode {cfg.mode}")
