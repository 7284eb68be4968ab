"""Shared parts of the registered queries: grain, rounding and SQL building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.config import DELTA_FEATURES, FEATURES, Config, SequenceConfig, SplitConfig, WindowConfig
from tidewatch.sources.adapters import duck

# About 14 events fall into an hour of the test tables, so the queries use hourly windows.
HOURLY = WindowConfig(window_seconds=3600.0, stride_seconds=3600.0, min_attack_ratio=0.25)
TEN_MINUTES = WindowConfig(window_seconds=600.0, stride_seconds=600.0, min_attack_flows=1, min_attack_ratio=0.25)
SHORT = SequenceConfig(history=6, horizon=3)
GRAIN = Config(window=HOURLY, sequence=SHORT,
               split=SplitConfig(long_episode_windows=4, rotation=("train", "val", "train", "test")))


def tidy(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to six digits (no negative zero), whole numbers to bigint."""
    out = []
    for field in (df.select(*columns) if columns else df).schema.fields:
        kind = field.dataType.typeName()
        col = F.col(f"`{field.name}`")
        if kind in ("double", "float"):
            col = F.round(col.cast("double"), 6) + F.lit(0.0)
        elif kind in ("integer", "short", "byte", "long"):
            col = col.cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)


def r6(expression: str, name: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6) + 0.0::DOUBLE AS {name}"


def unit_sql(*parts: str) -> str:
    """SQL of ``unit_draw``."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


def doubles(*names: str) -> str:
    return ", ".join(r6(n, n) for n in names)


def bigs(*names: str) -> str:
    return ", ".join(big(n, n) for n in names)


def assigned_sql(w: float = 3600.0) -> str:
    return f"""
flows AS ({duck('flows')}),
org AS (SELECT day, min(flow_start_epoch) AS t0 FROM flows GROUP BY day),
aw AS (SELECT f.*, CAST(floor((flow_start_epoch - t0) / {w}::DOUBLE) AS BIGINT) AS window_index,
         t0 + floor((flow_start_epoch - t0) / {w}::DOUBLE) * {w}::DOUBLE AS window_start
       FROM flows f JOIN org USING (day))"""


def volume_sql(w: float = 3600.0) -> str:
    w = f"{w}::DOUBLE"
    rates = ", ".join(f"sum(CAST(flag_{f} AS DOUBLE)) / {w} AS {f}_rate" for f in ("syn", "ack", "rst", "fin", "psh", "urg"))
    pk, by = "sum(CAST(fwd_pkts + bwd_pkts AS DOUBLE))", "sum(fwd_bytes + bwd_bytes)"
    sd = "coalesce(stddev_samp(flow_iat_mean), 0)"
    return f"""
vol AS (SELECT day, window_index, min(window_start) AS window_start, count(*) AS flow_count,
  {pk} AS packet_count, {by} AS byte_count, {pk} / {w} AS packet_rate, {by} / {w} AS byte_rate,
  sum(CAST(fwd_pkts AS DOUBLE)) / (sum(CAST(bwd_pkts AS DOUBLE)) + 1) AS fwd_bwd_ratio,
  avg(CASE WHEN flag_rst > 0 THEN 1.0 ELSE 0.0 END) AS failed_conn_ratio, {rates},
  avg(flow_duration) / 1000000.0::DOUBLE AS flow_duration_mean, avg(flow_iat_mean) AS iat_mean, {sd} AS iat_std,
  {sd} / (avg(flow_iat_mean) + 0.000001::DOUBLE) AS burstiness,
  avg(pkt_ttl_mean) AS ttl_mean, coalesce(var_samp(pkt_ttl_mean), 0) AS ttl_var,
  avg(pkt_win_mean) AS tcp_window_mean, coalesce(stddev_samp(pkt_win_mean), 0) AS tcp_window_std,
  avg(pkt_payload_var) AS payload_var_mean, avg(pkt_payload_nonzero_ratio) AS payload_nonzero_ratio,
  avg(pkt_payload_skew) AS payload_skew_mean, avg(pkt_payload_kurtosis) AS payload_kurt_mean,
  sum(CAST(retransmission_count AS DOUBLE)) / {w} AS retransmission_rate,
  avg(CAST(frag_more_flag_present AS DOUBLE)) + avg(CAST(frag_dont_flag_present AS DOUBLE)) AS frag_present_ratio,
  avg(port_scan_entropy) AS port_scan_entropy, max(port_scan_sequential_ratio) AS port_scan_seq_ratio,
  max(port_scan_max_sequential_run) AS port_scan_max_run, max(unique_dst_ports_per_src) AS unique_dst_ports_per_src,
  avg(CASE WHEN protocol = 6 THEN 1.0 ELSE 0.0 END) AS tcp_ratio,
  avg(CASE WHEN protocol = 17 THEN 1.0 ELSE 0.0 END) AS udp_ratio,
  avg(CASE WHEN flag_syn > 0 THEN 1.0 ELSE 0.0 END) AS syn_ratio,
  CAST(sum(is_attack) AS BIGINT) AS attack_flows, CAST(sum(is_attack) AS DOUBLE) / count(*) AS attack_ratio
  FROM aw GROUP BY day, window_index)"""


def entropy_sql(value: str, name: str) -> str:
    """Entropy in bits per window as its own CTE, written as -sum(p log2 p)."""
    return f"""
{name}_c AS (SELECT day, window_index, {value} AS v, CAST(count(*) AS DOUBLE) AS c FROM aw GROUP BY 1, 2, 3),
{name}_p AS (SELECT *, c / sum(c) OVER (PARTITION BY day, window_index) AS p FROM {name}_c),
{name}_e AS (SELECT day, window_index, -sum(p * log2(p)) AS {name}, count(*) AS distinct_{name} FROM {name}_p GROUP BY 1, 2)"""


SIZE_SQL = """
sz AS (SELECT day, window_index, ln(1 + fwd_bytes + bwd_bytes) AS s FROM aw),
szb AS (SELECT *, min(s) OVER (PARTITION BY day, window_index) AS lo, max(s) OVER (PARTITION BY day, window_index) AS hi FROM sz),
szc AS (SELECT day, window_index, CASE WHEN hi > lo THEN least(floor((s - lo) / (hi - lo) * 16), 15) ELSE 0 END AS slot, CAST(count(*) AS DOUBLE) AS c FROM szb GROUP BY 1, 2, 3),
szp AS (SELECT *, c / sum(c) OVER (PARTITION BY day, window_index) AS p FROM szc),
size_e AS (SELECT day, window_index, -sum(p * log2(p)) AS flowsize_entropy FROM szp GROUP BY 1, 2)"""

HOSTS_SQL = f"""
{entropy_sql('src_ip', 'srcip_entropy')}, {entropy_sql('dst_ip', 'dstip_entropy')},
uni AS (SELECT day, window_index, count(DISTINCT src_ip) AS unique_src, count(DISTINCT dst_ip) AS unique_dst,
  count(DISTINCT (src_ip, dst_ip)) AS unique_pairs FROM aw GROUP BY 1, 2),
fo AS (SELECT day, window_index, max(d) AS fan_out FROM (SELECT day, window_index, src_ip, count(DISTINCT dst_ip) AS d FROM aw GROUP BY 1, 2, 3) GROUP BY 1, 2),
fi AS (SELECT day, window_index, max(d) AS fan_in FROM (SELECT day, window_index, dst_ip, count(DISTINCT src_ip) AS d FROM aw GROUP BY 1, 2, 3) GROUP BY 1, 2)"""

DOMINANT_SQL = """
famc AS (SELECT day, window_index, attack_family, count(*) AS n FROM aw WHERE is_attack = 1 GROUP BY 1, 2, 3),
dom AS (SELECT day, window_index, attack_family AS dominant_family FROM famc
  QUALIFY row_number() OVER (PARTITION BY day, window_index ORDER BY n DESC, attack_family) = 1)"""


def windows_sql(w: float = 3600.0) -> str:
    """CTEs up to ``win``: one row per window, all features without neighbours."""
    return f"""{assigned_sql(w)}, {volume_sql(w)}, {HOSTS_SQL}, {entropy_sql('dst_port', 'dstport_entropy')}, {SIZE_SQL}, {DOMINANT_SQL},
win AS (SELECT vol.*, uni.unique_src, uni.unique_dst, uni.unique_pairs, distinct_dstport_entropy AS unique_dst_ports,
   fan_out, fan_in, dstport_entropy, dstip_entropy, srcip_entropy, flowsize_entropy, coalesce(dominant_family, 'BENIGN') AS dominant_family
 FROM vol JOIN uni USING (day, window_index) JOIN fo USING (day, window_index) JOIN fi USING (day, window_index)
 JOIN dstport_entropy_e USING (day, window_index) JOIN dstip_entropy_e USING (day, window_index)
 JOIN srcip_entropy_e USING (day, window_index) JOIN size_e USING (day, window_index) LEFT JOIN dom USING (day, window_index))"""


def filled_sql(w: float = 3600.0, max_gap: int = 60, source: str = "win", name: str = "filled") -> str:
    """Zero rows for the missing indices of short gaps; every number of ``source`` becomes 0."""
    numbers = [f for f in FEATURES if not f.startswith("d_") and f not in ("time_since_prev_window", "window_index_in_day")]
    zeros = ", ".join(f"coalesce({n}, 0) AS {n}" for n in numbers + ["attack_flows", "attack_ratio", "syn_ratio"])
    return f"""
gaps AS (SELECT day, window_index, window_start, lead(window_index) OVER (PARTITION BY day ORDER BY window_index) AS nxt FROM {source}),
holes AS (SELECT day, unnest(generate_series(window_index + 1, nxt - 1)) AS wi, window_index, window_start FROM gaps
  WHERE nxt - window_index > 1 AND nxt - window_index <= {max_gap + 1}),
slots AS (SELECT day, window_index, window_start FROM {source}
  UNION ALL SELECT day, wi, window_start + (wi - window_index) * {w}::DOUBLE FROM holes),
{name} AS (SELECT s.day, s.window_index, s.window_start, coalesce(dominant_family, 'BENIGN') AS dominant_family, {zeros}
  FROM slots s LEFT JOIN {source} x ON x.day = s.day AND x.window_index = s.window_index)"""


def progression_sql(cfg: WindowConfig = HOURLY, source: str = "filled", name: str = "prog") -> str:
    r, o = cfg.smooth_radius, "PARTITION BY day ORDER BY window_index"
    pre = " OR ".join(
        "(" + " AND ".join([f"lead(atk, {j}) OVER w = 0" for j in range(1, k)]
                           + [f"lead(atk, {k}) OVER w = 1", f"lead(window_index, {k}) OVER w - window_index = {k}"]) + ")"
        for k in range(1, cfg.pre_attack_span + 1))
    return f"""
rawf AS (SELECT *, CASE WHEN attack_flows >= {cfg.min_attack_flows} AND attack_ratio >= {cfg.min_attack_ratio} THEN 1 ELSE 0 END AS raw FROM {source}),
smo AS (SELECT *, CASE WHEN avg(raw) OVER ({o} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) >= 0.5 THEN 1 ELSE 0 END AS atk FROM rawf),
sta AS (SELECT *, CASE WHEN atk = 1 AND coalesce(lag(atk) OVER ({o}), 0) = 0 THEN 1 ELSE 0 END AS st FROM smo),
epi AS (SELECT *, sum(st) OVER ({o}) AS ep, coalesce({pre}, false) AS pre FROM sta WINDOW w AS ({o})),
pos AS (SELECT *, row_number() OVER (PARTITION BY day, atk, ep ORDER BY window_index) AS pos,
  count(*) OVER (PARTITION BY day, atk, ep) AS len, max(attack_ratio) OVER (PARTITION BY day, atk, ep) AS peak,
  coalesce(last_value(CASE WHEN dominant_family <> 'BENIGN' THEN dominant_family END IGNORE NULLS)
    OVER (PARTITION BY day, atk, ep ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'BENIGN') AS prev FROM epi),
{name} AS (SELECT *, CASE WHEN atk = 1 AND pos = 1 THEN 'ONSET'
   WHEN atk = 1 AND ((pos = len AND attack_ratio < 0.5 * peak) OR (dominant_family <> 'BENIGN' AND dominant_family <> prev)) THEN 'CONTINUATION'
   WHEN atk = 1 THEN 'ACTIVE' WHEN pre THEN 'PRE_ATTACK' ELSE 'NORMAL' END AS progression_state, atk AS y_attack FROM pos)"""


def time_sql(w: float = 3600.0, source: str = "prog", name: str = "timed") -> str:
    o = "(PARTITION BY day ORDER BY window_index)"
    deltas = ", ".join(f"coalesce({f} - lag({f}) OVER {o}, 0) AS d_{f}" for f in DELTA_FEATURES)
    return f"""
{name} AS (SELECT *, coalesce(window_start - lag(window_start) OVER {o}, {w}) AS time_since_prev_window,
  row_number() OVER {o} - 1 AS window_index_in_day, {deltas} FROM {source})"""


STATE_INDEX_SQL = ("CASE progression_state WHEN 'NORMAL' THEN 0 WHEN 'PRE_ATTACK' THEN 1 WHEN 'ONSET' THEN 2 "
                   "WHEN 'ACTIVE' THEN 3 ELSE 4 END")
