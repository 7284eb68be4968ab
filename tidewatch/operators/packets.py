"""Packet table -> typed packets, scan statistics and simple bidirectional flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.functions.columns import endpoint_key, finite
from tidewatch.functions.grouped import entropy_aggregate, value_counts

# TCP flag bits and header defaults.
FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20, "ece": 0x40, "cwr": 0x80}
UDP_HEADER = 8
TCP_HEADER = 20
SCAN_SECONDS = 5


def flag_value(text: Column) -> Column:
    """Hexadecimal (0x..) or decimal text -> whole number; junk -> 0."""
    digits = F.substring(text, 3, 16)
    hexa = F.when(digits.rlike("^[0-9A-Fa-f]+$"), F.conv(digits, 16, 10).try_cast("bigint"))
    return F.coalesce(F.when(text.startswith("0x"), hexa).otherwise(text.try_cast("bigint")), F.lit(0))


def clean_packets(raw: DataFrame, keep: tuple = ()) -> DataFrame:
    """All-text packet table -> typed packets. Packets without TCP or UDP header stay as protocol 0."""
    def text(name):
        return F.col(f"`{name}`")

    def num(name, default=0.0):
        return F.coalesce(finite(text(name)), F.lit(float(default)))

    tcp = text("tcp.srcport") != ""
    udp = ~tcp & (text("udp.srcport") != "")

    def by_protocol(on_tcp, on_udp, other):
        return F.when(tcp, on_tcp).when(udp, on_udp).otherwise(other)

    ts = finite(text("frame.time_epoch"))
    bits = flag_value(text("tcp.flags"))
    rows = raw.where((text("ip.src") != "") & ts.isNotNull())
    return rows.select(
        *keep, ts.alias("ts"), F.rint(ts * 1000000.0).cast("bigint").alias("ts_us"),
        text("ip.src").alias("src_ip"), text("ip.dst").alias("dst_ip"),
        by_protocol(num("tcp.srcport"), num("udp.srcport"), F.lit(0.0)).cast("int").alias("sport"),
        by_protocol(num("tcp.dstport"), num("udp.dstport"), F.lit(0.0)).cast("int").alias("dport"),
        by_protocol(F.lit(6), F.lit(17), F.lit(0)).alias("proto"),
        tcp.alias("is_tcp"), (~tcp & ~udp).alias("is_other"),
        num("frame.len").alias("frame_len"), num("ip.ttl").alias("ttl"),
        by_protocol(num("tcp.len"), F.greatest(num("udp.length", UDP_HEADER) - UDP_HEADER, F.lit(0.0)), F.lit(0.0)).alias("payload_len"),
        by_protocol(num("tcp.hdr_len", TCP_HEADER), F.lit(float(UDP_HEADER)), F.lit(0.0)).alias("header_len"),
        F.when(tcp, num("tcp.window_size_value")).otherwise(F.lit(-1.0)).alias("tcp_window"),
        (text("ip.flags.mf") == "1").alias("more_frag"), (text("ip.flags.df") == "1").alias("dont_frag"),
        num("ip.frag_offset").alias("frag_offset"), (text("tcp.analysis.retransmission") == "1").alias("is_retx"),
        *[(tcp & (bits.bitwiseAND(F.lit(b)) != 0)).cast("int").alias(f) for f, b in FLAG_BITS.items()])


def packet_key() -> Column:
    return endpoint_key(F.col("src_ip"), F.col("sport"), F.col("dst_ip"), F.col("dport"), F.col("proto"))


def scan_statistics(packets: DataFrame, order: list[str], seconds: int = SCAN_SECONDS, ts: str = "ts") -> DataFrame:
    """Per source and 5-second bucket: port entropy, distinct ports and runs of neighbouring ports.

    A bucket never holds more packets than its source can send in five seconds.
    """
    rows = packets.withColumn("timestamp_window", F.floor(F.col(ts) / seconds).cast("bigint"))
    by = ["src_ip", "timestamp_window"]
    spread = value_counts(rows, by, ["dport"]).groupBy(*by).agg(
        entropy_aggregate(F.col("n")).alias("port_scan_entropy"), F.count(F.lit(1)).alias("unique_dst_ports_per_src"))
    arrival = W.partitionBy(*by).orderBy(ts, *order)
    step = F.abs(F.col("dport") - F.lag("dport").over(arrival))
    moves = rows.withColumn("_step", step).withColumn("_seq", F.coalesce(F.col("_step") == 1, F.lit(False)))
    moves = moves.withColumn("_run", F.sum((~F.col("_seq")).cast("int")).over(arrival))
    runs = moves.groupBy(*by, "_run").agg(
        F.sum(F.col("_seq").cast("int")).alias("seq"), F.count("_step").alias("trans"))
    runs = runs.groupBy(*by).agg(
        F.max("seq").alias("port_scan_max_sequential_run"),
        F.when(F.sum("trans") > 0, F.sum("seq") / F.sum("trans")).otherwise(0.0).alias("port_scan_sequential_ratio"))
    return spread.join(runs, by)


def enrich_with_scans(flows: DataFrame, scans: DataFrame, seconds: int = SCAN_SECONDS) -> DataFrame:
    """Left join of the scan statistics on (source, start bucket); no match -> 0."""
    rows = flows.withColumn("timestamp_window", F.floor(F.col("flow_start_epoch") / seconds).cast("bigint"))
    names = ["port_scan_entropy", "unique_dst_ports_per_src", "port_scan_max_sequential_run", "port_scan_sequential_ratio"]
    joined = rows.join(scans, ["src_ip", "timestamp_window"], "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(0)) for n in names})


def simple_flows(packets: DataFrame, order: str = "pkt_id", ts: str = "ts", length: str = "frame_len") -> DataFrame:
    """One bidirectional flow per 5-tuple without timeouts; the first packet gives the direction.

    Packets collapse to one row per key and sender first, so a long conversation is
    two partial rows and never a group: the gaps of one direction add up to last - first.
    """
    have = set(packets.columns)
    rows = packets.where(F.col("proto").isin(6, 17)).withColumn("key", packet_key())
    flags = ["fin", "syn", "rst", "psh", "ack", "urg"]
    seen = [F.max(((F.col(f) != 0) & (F.col("proto") == 6)).cast("int") if f in have else F.lit(0)).alias(f) for f in flags]
    first = F.min(F.struct(F.col(ts).alias("t"), F.col(order).alias("o"))).alias("first")
    side = rows.groupBy("key", "src_ip", "sport", "dst_ip", "dport", "proto").agg(
        first, F.min(ts).alias("t0"), F.max(ts).alias("t1"), F.count(F.lit(1)).alias("n"), F.sum(length).alias("octets"), *seen)
    both = side.groupBy("key").agg(
        F.min(F.struct("first", "src_ip", "sport", "dst_ip", "dport", "proto", "n", "octets", "t0", "t1")).alias("f"),
        F.sum("n").alias("n"), F.sum("octets").alias("octets"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
        F.sum(F.col("t1") - F.col("t0")).alias("gaps"), *[F.max(f).alias(f) for f in flags])
    span = (F.col("t1") - F.col("t0")) * 1000000.0
    fwd_gap = (F.col("f.t1") - F.col("f.t0")) * 1000000.0
    return both.select(
        F.col("f.src_ip").alias("src_ip"), F.col("f.dst_ip").alias("dst_ip"), F.col("f.sport").alias("src_port"),
        F.col("f.dport").alias("dst_port"), F.col("f.proto").alias("protocol"),
        F.round("t0", 6).alias("flow_start_epoch"), F.round(span, 1).alias("flow_duration"),
        F.round(span / F.greatest(F.col("n") - 1, F.lit(1)), 3).alias("flow_iat_mean"),
        F.col("f.n").alias("fwd_pkts"), (F.col("n") - F.col("f.n")).alias("bwd_pkts"),
        F.col("f.octets").alias("fwd_bytes"), (F.col("octets") - F.col("f.octets")).alias("bwd_bytes"),
        F.round(fwd_gap, 1).alias("Fwd IAT Total"), F.round(F.col("gaps") * 1000000.0 - fwd_gap, 1).alias("Bwd IAT Total"),
        F.round(F.col("octets") / F.col("n"), 2).alias("pkt_len_mean"), *[F.col(f).alias(f"flag_{f}") for f in flags])


def moments(rows: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Mean, variance, skew (0 under 3 rows), excess kurtosis (0 under 4), non-zero share, min and max."""
    v = F.col(value).cast("double")
    return rows.groupBy(*group).agg(*moment_columns(v, name))


def moment_columns(v: Column, name: str) -> list[Column]:
    n, var = F.count(v), F.coalesce(F.var_samp(v), F.lit(0.0))

    def shape(fn, least):
        return F.when((n >= least) & (var > 0), fn(v)).otherwise(F.lit(0.0))

    return [
        F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{name}_mean"), var.alias(f"{name}_var"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{name}_std"),
        shape(F.skewness, 3).alias(f"{name}_skew"), shape(F.kurtosis, 4).alias(f"{name}_kurtosis"),
        F.coalesce(F.avg((v != 0).cast("double")), F.lit(0.0)).alias(f"{name}_nonzero_ratio"),
        F.coalesce(F.min(v), F.lit(0.0)).alias(f"{name}_min"), F.coalesce(F.max(v), F.lit(0.0)).alias(f"{name}_max")]
