"""Raw flow tables -> typed, labelled, clipped flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import BENIGN, DAY_SPLIT
from tidewatch.functions.columns import attack_family, day_name, finite
from tidewatch.functions.grouped import quantiles
from tidewatch.sources.contract import FLAG_COUNTS, FLOW_NUMBERS, PACKET_NUMBERS, RATE_COLUMNS, ContractError, name, trim_names

NUMBERS = FLOW_NUMBERS + PACKET_NUMBERS + tuple(FLAG_COUNTS)


def label_flows(df: DataFrame) -> DataFrame:
    """Label text -> ``attack_family`` and ``is_attack``; no label means benign."""
    if "Label" not in df.columns:
        raise ContractError("Label column missing: run the label transfer first")
    family = attack_family(F.col("Label"))
    return df.withColumns({
        "Label": F.trim(F.coalesce(F.col("Label"), F.lit(BENIGN))),
        "attack_family": family, "is_attack": (family != BENIGN).cast("int")})


def assign_day(df: DataFrame) -> DataFrame:
    """Day from the source name; without one an existing ``day`` stays, else it is ``Unknown``."""
    source = next((c for c in ("source_day", "source_file") if c in df.columns), None)
    if source is None and "day" in df.columns:
        return df
    return df.withColumn("day", day_name(F.col(source)) if source else F.lit("Unknown"))


def _numeric(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    return name(column).cast("double") if kind == "boolean" else finite(name(column))


def fixed_cells(df: DataFrame, columns=None) -> DataFrame:
    """Number of cells per column that cleaning sets to zero, plus their total."""
    columns = [c for c in (columns or NUMBERS) if c in df.columns]
    one = df.agg(*[F.sum(_numeric(df, c).isNull().cast("long")).alias(c) for c in columns])
    return one.withColumn("all_columns", reduce(lambda a, b: a + b, [F.coalesce(name(c), F.lit(0)) for c in columns]))


def coerce_numbers(df: DataFrame, columns=None) -> DataFrame:
    columns = [c for c in (columns or NUMBERS) if c in df.columns]
    return df.withColumns({c: F.coalesce(_numeric(df, c), F.lit(0.0)) for c in columns})


def rate_limits(df: DataFrame, p: float = 0.999, columns=RATE_COLUMNS, by=(), method: str = "exact") -> DataFrame:
    """Upper bound per rate column from the training days (all rows when there is none)."""
    by = list(by)
    columns = [c for c in columns if c in df.columns]
    train = [d for d, s in DAY_SPLIT.items() if s == "train"]
    fit = df
    if "day" in df.columns:
        on_train = df.where(F.col("day").isin(*train))
        fit = on_train if on_train.select("day").take(1) else df
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), name(c).cast("double").alias("value")) for c in columns]))
    long = fit.select(*by, pairs.alias("x")).select(*by, "x.column", "x.value")
    return quantiles(long, by + ["column"], "value", [p], method=method).select(*by, "column", F.col("q").alias("high"))


def winsorise(df: DataFrame, p: float = 0.999, columns=RATE_COLUMNS, method: str = "exact") -> DataFrame:
    """Cap the rate columns; the four bounds come back to the driver and enter the plan as literals."""
    if not any(c in df.columns for c in columns):
        return df
    limits = {r["column"]: r["high"] for r in rate_limits(df, p, columns, (), method).collect()}
    return df.withColumns({c: F.least(name(c), F.lit(h)) for c, h in limits.items() if h is not None and h > 0})


def type_identity(df: DataFrame) -> DataFrame:
    numbers = {c: F.coalesce(finite(name(c)), F.lit(0.0)).cast("int")
               for c in ("Source Port", "Destination Port", "Protocol") if c in df.columns}
    texts = {c: name(c).cast("string") for c in ("Source IP", "Destination IP", "Flow ID") if c in df.columns}
    return df.withColumns({**numbers, **texts})


def clean_flows(df: DataFrame, clip: bool = True, method: str = "exact") -> DataFrame:
    """Labels, day, valid time, numbers, clipped rates and typed identity columns."""
    df = assign_day(label_flows(trim_names(df)))
    if "flow_start_epoch" not in df.columns:
        raise ContractError("flow_start_epoch column missing")
    df = df.withColumn("flow_start_epoch", finite(F.col("flow_start_epoch"))).where(F.col("flow_start_epoch").isNotNull())
    df = coerce_numbers(df)
    df = winsorise(df, method=method) if clip else df
    return type_identity(df)


def systematic_sample(df: DataFrame, time: str, start, end, target: int, tiebreak: list[str]) -> DataFrame:
    """Rows of a time range, then every n-th in time order so that about ``target`` remain.

    Positions come from per-minute counts plus the position inside the minute,
    so the range is never sorted in one task.
    """
    rows = df.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end))).withColumn("_m", F.floor(F.col(time) / 60))
    minutes = rows.groupBy("_m").agg(F.count(F.lit(1)).alias("_n"))
    before = minutes.withColumns({
        "_before": F.sum("_n").over(W.orderBy("_m")) - F.col("_n"),
        "_step": F.greatest(F.lit(1), F.floor(F.sum("_n").over(W.partitionBy()) / target)),
    })
    place = F.col("_before") + F.row_number().over(W.partitionBy("_m").orderBy(time, *tiebreak)) - 1
    picked = rows.join(before.drop("_n"), "_m").withColumn("_place", place)
    return picked.where(F.col("_place") % F.col("_step") == 0).drop("_m", "_before", "_step", "_place")


def non_finite_cells(df: DataFrame, columns=RATE_COLUMNS) -> DataFrame:
    def odd(c):
        v = name(c).try_cast("double")
        return (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).cast("long")
    return df.agg(*[F.coalesce(F.sum(odd(c)), F.lit(0)).alias(c) for c in columns if c in df.columns])


def packet_filter(protocol: int | None = None, host: str | None = None, port: int | None = None,
                  skip_broadcast: bool = False, src: str = "src_ip", dst: str = "dst_ip",
                  sport: str = "sport", dport: str = "dport", proto: str = "proto") -> Column:
    """Conjunction of capture conditions; combine several with ``&``, ``|`` and ``~``."""
    parts = [F.lit(True)]
    if protocol is not None:
        parts.append(F.col(proto) == protocol)
    if host is not None:
        parts.append((F.col(src) == host) | (F.col(dst) == host))
    if port is not None:
        parts.append((F.col(sport) == port) | (F.col(dport) == port))
    if skip_broadcast:
        first = F.split(F.col(dst), r"\.")[0].try_cast("int")
        parts.append((F.col(dst) != "255.255.255.255") & ~F.coalesce(first.between(224, 239), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)
