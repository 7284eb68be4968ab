"""Flows -> fixed time windows with traffic features.

``keys`` is the list of partition columns (``["day"]``, ``["sensor", "day"]``, ...).
Flow-grain work is partial aggregation only; ordered windows run at window grain,
where one partition holds at most (seconds per day / stride) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import BENIGN, DELTA_FEATURES, FEATURES, WindowConfig
from tidewatch.functions.columns import finite_or_zero
from tidewatch.functions.grouped import entropy_aggregate, salted_join, value_counts
from tidewatch.session import stored

TIME = "flow_start_epoch"
SIZE_BINS = 16


def origins(flows: DataFrame, keys: list[str]) -> DataFrame:
    """First event per partition: windows count from here, not from the epoch."""
    return flows.groupBy(*keys).agg(F.min(TIME).alias("t0"))


def assign_windows(flows: DataFrame, cfg: WindowConfig = WindowConfig(), keys=("day",),
                   start: DataFrame | None = None) -> DataFrame:
    """Add ``window_index`` and ``window_start``; overlapping windows repeat a row."""
    keys = list(keys)
    # written, because a size estimate of the aggregate follows the flows: Spark would shuffle them all for one number a day
    start = stored(origins(flows, keys), "origins") if start is None else start
    rows = flows.join(start, keys)
    since = F.col(TIME) - F.col("t0")
    if cfg.stride_seconds >= cfg.window_seconds:
        index: Column = F.floor(since / cfg.window_seconds)
        step = cfg.window_seconds
    else:
        step = cfg.stride_seconds
        first = F.greatest(F.floor((since - cfg.window_seconds) / step) + 1, F.lit(0))
        index = F.explode(F.sequence(first, F.floor(since / step)))
    rows = rows.withColumn("window_index", index)
    return rows.withColumn("window_start", F.col("t0") + F.col("window_index") * F.lit(float(step))).drop("t0")


def volume_features(rows: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """All features that are plain aggregates of the window's flows."""
    have = set(rows.columns)
    w = float(seconds)

    def col(name):
        return F.col(name) if name in have else F.lit(0)

    def mean(name):
        return F.avg(col(name).cast("double"))

    def total(name):
        return F.sum(col(name).cast("double"))

    def spread(fn, name):
        return F.coalesce(fn(col(name).cast("double")), F.lit(0.0))

    iat_std = spread(F.stddev_samp, "flow_iat_mean")
    packets = total("fwd_pkts") + total("bwd_pkts")
    octets = total("fwd_bytes") + total("bwd_bytes")
    attacks = F.sum(col("is_attack").cast("long"))
    return rows.groupBy(*by).agg(
        F.min("window_start").alias("window_start"),
        F.count(F.lit(1)).alias("flow_count"),
        packets.alias("packet_count"),
        octets.alias("byte_count"),
        (packets / w).alias("packet_rate"),
        (octets / w).alias("byte_rate"),
        (total("fwd_pkts") / (total("bwd_pkts") + 1.0)).alias("fwd_bwd_ratio"),
        F.avg((col("flag_rst") > 0).cast("double")).alias("failed_conn_ratio"),
        *[(total(f"flag_{f}") / w).alias(f"{f}_rate") for f in ("syn", "ack", "rst", "fin", "psh", "urg")],
        (mean("flow_duration") / 1e6).alias("flow_duration_mean"),
        mean("flow_iat_mean").alias("iat_mean"),
        iat_std.alias("iat_std"),
        (iat_std / (mean("flow_iat_mean") + 1e-6)).alias("burstiness"),
        mean("pkt_ttl_mean").alias("ttl_mean"),
        spread(F.var_samp, "pkt_ttl_mean").alias("ttl_var"),
        mean("pkt_win_mean").alias("tcp_window_mean"),
        spread(F.stddev_samp, "pkt_win_mean").alias("tcp_window_std"),
        mean("pkt_payload_var").alias("payload_var_mean"),
        mean("pkt_payload_nonzero_ratio").alias("payload_nonzero_ratio"),
        mean("pkt_payload_skew").alias("payload_skew_mean"),
        mean("pkt_payload_kurtosis").alias("payload_kurt_mean"),
        (total("retransmission_count") / w).alias("retransmission_rate"),
        (mean("frag_more_flag_present") + mean("frag_dont_flag_present")).alias("frag_present_ratio"),
        mean("port_scan_entropy").alias("port_scan_entropy"),
        F.max(col("port_scan_sequential_ratio")).alias("port_scan_seq_ratio"),
        F.max(col("port_scan_max_sequential_run")).alias("port_scan_max_run"),
        F.max(col("unique_dst_ports_per_src")).alias("unique_dst_ports_per_src"),
        F.avg((F.col("protocol") == 6).cast("double")).alias("tcp_ratio"),
        F.avg((F.col("protocol") == 17).cast("double")).alias("udp_ratio"),
        # inputs of the detection rules, taken from raw windows
        F.avg((col("flag_syn") > 0).cast("double")).alias("syn_ratio"),
        F.max(col("is_synthetic").cast("int")).alias("is_synthetic"),
        attacks.alias("attack_flows"),
        (attacks / F.count(F.lit(1))).alias("attack_ratio"),
    )


def host_features(rows: DataFrame, by: list[str]) -> DataFrame:
    """Distinct hosts and pairs, fan-out / fan-in and address entropies from one pair table."""
    pairs = value_counts(rows, by, ["src_ip", "dst_ip"])
    by_src = (
        pairs.groupBy(*by, "src_ip").agg(F.count(F.lit(1)).alias("peers"), F.sum("n").alias("n"))
        .groupBy(*by).agg(
            F.count(F.lit(1)).alias("unique_src"), F.sum("peers").alias("unique_pairs"),
            F.max("peers").alias("fan_out"), entropy_aggregate(F.col("n")).alias("srcip_entropy"))
    )
    by_dst = (
        pairs.groupBy(*by, "dst_ip").agg(F.count(F.lit(1)).alias("peers"), F.sum("n").alias("n"))
        .groupBy(*by).agg(
            F.count(F.lit(1)).alias("unique_dst"), F.max("peers").alias("fan_in"),
            entropy_aggregate(F.col("n")).alias("dstip_entropy"))
    )
    return by_src.join(by_dst, by)


def port_features(rows: DataFrame, by: list[str]) -> DataFrame:
    return value_counts(rows, by, ["dst_port"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("unique_dst_ports"), entropy_aggregate(F.col("n")).alias("dstport_entropy"))


def size_entropy(rows: DataFrame, by: list[str]) -> DataFrame:
    """Entropy of 16 equal bins of log1p(bytes) between the window's own minimum and maximum."""
    sizes = value_counts(
        rows.withColumn("size", F.log1p((F.col("fwd_bytes") + F.col("bwd_bytes")).cast("double"))), by, ["size"])
    limits = sizes.groupBy(*by).agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    span = F.col("hi") - F.col("lo")
    slot = F.when(span > 0, F.least(
        F.floor((F.col("size") - F.col("lo")) / F.when(span > 0, span) * SIZE_BINS), F.lit(SIZE_BINS - 1))).otherwise(F.lit(0))
    return (
        salted_join(sizes, limits, by, F.col("size"))
        .groupBy(*by, slot.alias("slot")).agg(F.sum("n").alias("n"))
        .groupBy(*by).agg(entropy_aggregate(F.col("n")).alias("flowsize_entropy"))
    )


def dominant_family(rows: DataFrame, by: list[str]) -> DataFrame:
    """Most frequent family among attack flows; equal counts go to the smaller name."""
    counts = value_counts(rows.where(F.col("is_attack") == 1), by, ["attack_family"])
    best = F.min_by("attack_family", F.struct((-F.col("n")).alias("c"), F.col("attack_family").alias("f")))
    return counts.groupBy(*by).agg(best.alias("dominant_family"))


def aggregate_windows(assigned: DataFrame, cfg: WindowConfig = WindowConfig(), keys=("day",)) -> DataFrame:
    """One row per (keys, window_index) with every feature that needs no neighbour window."""
    by = list(keys) + ["window_index"]
    out = volume_features(assigned, by, cfg.window_seconds)
    for part in (host_features, port_features, size_entropy):
        out = out.join(part(assigned, by), by)
    out = out.join(dominant_family(assigned, by), by, "left")
    return out.withColumn("dominant_family", F.coalesce("dominant_family", F.lit(BENIGN)))


def fill_idle(windows: DataFrame, cfg: WindowConfig = WindowConfig(), keys=("day",)) -> DataFrame:
    """Insert zero-traffic windows into gaps of up to ``max_idle_gap`` missing windows."""
    keys = list(keys)
    step = float(min(cfg.stride_seconds, cfg.window_seconds))
    index = F.col("window_index")
    nxt = F.lead("window_index").over(W.partitionBy(*keys).orderBy("window_index"))
    fillable = (F.col("_next") - index > 1) & (F.col("_next") - index <= cfg.max_idle_gap + 1)
    last = F.when(fillable, F.col("_next") - 1).otherwise(index)
    rows = windows.withColumn("_next", nxt).withColumn("_i", F.explode(F.sequence(index, last)))
    own = F.col("_i") == index
    out = []
    for f in windows.schema.fields:
        c = F.col(f.name)
        if f.name in keys:
            out.append(c)
        elif f.name == "window_index":
            out.append(F.col("_i").alias(f.name))
        elif f.name == "window_start":
            out.append((c + (F.col("_i") - index) * F.lit(step)).alias(f.name))
        elif f.name == "dominant_family":
            out.append(F.when(own, F.coalesce(c, F.lit(BENIGN))).otherwise(BENIGN).alias(f.name))
        elif f.dataType.typeName() in ("string", "boolean"):
            out.append(F.when(own, c).alias(f.name))
        else:
            out.append(F.when(own, F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast(f.dataType).alias(f.name))
    return rows.select(*out)


def time_features(windows: DataFrame, cfg: WindowConfig = WindowConfig(), keys=("day",)) -> DataFrame:
    """Seconds since the previous window, ordinal in the day and first differences."""
    order = W.partitionBy(*keys).orderBy("window_index")
    adds = {
        "time_since_prev_window": F.coalesce(
            F.col("window_start") - F.lag("window_start").over(order), F.lit(float(cfg.window_seconds))),
        "window_index_in_day": F.row_number().over(order) - 1,
    }
    for f in DELTA_FEATURES:
        adds[f"d_{f}"] = F.coalesce(F.col(f) - F.lag(f).over(order), F.lit(0)).cast("double")
    return windows.withColumns(adds)


def guard_features(windows: DataFrame) -> DataFrame:
    """Every feature present, finite and double."""
    have = set(windows.columns)
    rest = [c for c in windows.columns if c not in FEATURES]
    return windows.select(
        *rest, *[(finite_or_zero(F.col(f)) if f in have else F.lit(0.0)).alias(f) for f in FEATURES])


def epoch_windows(flows: DataFrame, seconds: int = 5, keys=("source_file",)) -> DataFrame:
    """Second windowing form: epoch-aligned buckets with a sum / mean / std / max / count list."""
    have = set(flows.columns)
    bucket = F.floor(F.col(TIME) / seconds).cast("long").alias("timestamp_window")
    sums = ["fwd_pkts", "bwd_pkts", "packet_count", "retransmission_count", "syn_packet_count", "non_tcp_udp_packet_count"]
    both = ["pkt_ttl_mean", "pkt_win_mean"]
    means = ["pkt_ttl_std", "pkt_payload_var", "pkt_payload_skew", "pkt_payload_kurtosis", "pkt_payload_nonzero_ratio"]
    tops = ["frag_more_flag_present", "frag_dont_flag_present", "frag_max_offset", "port_scan_entropy",
            "unique_dst_ports_per_src", "port_scan_max_sequential_run", "port_scan_sequential_ratio"]
    aggs = [F.sum(c).alias(f"{c}_sum") for c in sums if c in have]
    for c in both:
        if c in have:
            aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in means if c in have]
    aggs += [F.max(c).alias(f"{c}_max") for c in tops if c in have]
    aggs.append(F.count("src_ip").alias("flows_in_window"))
    return flows.groupBy(*keys, bucket).agg(*aggs)
