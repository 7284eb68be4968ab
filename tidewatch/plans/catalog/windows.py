"""Window, feature, progression and phase queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.config import FEATURES
from tidewatch.operators import phases, progression, reports
from tidewatch.operators import windows as ops
from tidewatch.plans.catalog.common import (
    DOMINANT_SQL, HOSTS_SQL, HOURLY, SIZE_SQL, STATE_INDEX_SQL, TEN_MINUTES, assigned_sql, big, bigs, doubles,
    entropy_sql, filled_sql, progression_sql, r6, tidy, time_sql, volume_sql, windows_sql,
)
from tidewatch.plans.corpus import state_windows
from tidewatch.sources.adapters import duck, view
from tidewatch.streaming import windows as live

BY = ["day", "window_index"]
FLAGS = [f"{f}_rate" for f in ("syn", "ack", "rst", "fin", "psh", "urg")]
VOLUME = ["packet_count", "byte_count", "packet_rate", "byte_rate", "fwd_bwd_ratio"]
TIMING = ["flow_duration_mean", "iat_mean", "iat_std", "burstiness"]
PACKET = ["ttl_mean", "ttl_var", "tcp_window_mean", "tcp_window_std", "payload_var_mean", "payload_nonzero_ratio",
          "payload_skew_mean", "payload_kurt_mean", "retransmission_rate", "frag_present_ratio"]
SCAN = ["port_scan_entropy", "port_scan_seq_ratio", "port_scan_max_run", "unique_dst_ports_per_src"]


def hourly(spark, sf):
    return ops.assign_windows(view(spark, sf, "flows"), HOURLY)


def tumbling(spark, sf):
    return tidy(hourly(spark, sf).groupBy(*BY).agg(
        F.count(F.lit(1)).alias("flows"), F.min("window_start").alias("window_start")))


TUMBLING = f"""WITH {assigned_sql()}
SELECT day, window_index, {big('count(*)', 'flows')}, {r6('min(window_start)', 'window_start')} FROM aw GROUP BY 1, 2"""


def sliding(spark, sf):
    from dataclasses import replace
    cfg = replace(HOURLY, stride_seconds=900.0)
    rows = ops.assign_windows(view(spark, sf, "flows"), cfg)
    return tidy(rows.groupBy(*BY).agg(F.count(F.lit(1)).alias("flows"), F.sum("fwd_bytes").alias("fwd_bytes"),
                                      F.min("window_start").alias("window_start")))


SLIDING = f"""WITH flows AS ({duck('flows')}),
org AS (SELECT day, min(flow_start_epoch) AS t0 FROM flows GROUP BY day),
rel AS (SELECT f.day, fwd_bytes, t0, flow_start_epoch - t0 AS rel FROM flows f JOIN org USING (day)),
rep AS (SELECT day, fwd_bytes, t0, unnest(generate_series(
   CAST(greatest(floor((rel - 3600) / 900) + 1, 0) AS BIGINT), CAST(floor(rel / 900) AS BIGINT))) AS window_index FROM rel)
SELECT day, window_index, {big('count(*)', 'flows')}, {r6('sum(fwd_bytes)', 'fwd_bytes')},
 {r6('min(t0 + window_index * 900.0::DOUBLE)', 'window_start')} FROM rep GROUP BY 1, 2"""


def volume(spark, sf, names):
    rows = ops.volume_features(hourly(spark, sf), BY, HOURLY.window_seconds)
    return tidy(rows, *BY, *names)


def volume_text(names, whole=()):
    parts = [bigs(*whole)] if whole else []
    return f"WITH {assigned_sql()}, {volume_sql()} SELECT day, window_index, {', '.join(parts + [doubles(*names)])} FROM vol"


def hosts(spark, sf):
    return tidy(ops.host_features(hourly(spark, sf), BY))


HOSTS = f"""WITH {assigned_sql()}, {HOSTS_SQL}
SELECT day, window_index, {bigs('unique_src', 'unique_dst', 'unique_pairs', 'fan_out', 'fan_in')}, {doubles('srcip_entropy', 'dstip_entropy')}
FROM uni JOIN fo USING (day, window_index) JOIN fi USING (day, window_index)
JOIN srcip_entropy_e USING (day, window_index) JOIN dstip_entropy_e USING (day, window_index)"""


def ports(spark, sf):
    return tidy(ops.port_features(hourly(spark, sf), BY))


PORTS = f"""WITH {assigned_sql()}, {entropy_sql('dst_port', 'dstport_entropy')}
SELECT day, window_index, {big('distinct_dstport_entropy', 'unique_dst_ports')}, {doubles('dstport_entropy')} FROM dstport_entropy_e"""


def sizes(spark, sf):
    return tidy(ops.size_entropy(hourly(spark, sf), BY))


SIZES = f"WITH {assigned_sql()}, {SIZE_SQL} SELECT day, window_index, {doubles('flowsize_entropy')} FROM size_e"


def dominant(spark, sf):
    return tidy(ops.dominant_family(hourly(spark, sf), BY))


DOMINANT = f"WITH {assigned_sql()}, {DOMINANT_SQL} SELECT day, window_index, dominant_family FROM dom"


def idle(spark, sf):
    rows = ops.aggregate_windows(ops.assign_windows(view(spark, sf, "flows"), TEN_MINUTES), TEN_MINUTES)
    return tidy(ops.fill_idle(rows, TEN_MINUTES), *BY, "window_start", "dominant_family", "flow_count", "byte_rate",
                "dstip_entropy", "attack_flows", "attack_ratio")


IDLE = f"""WITH {windows_sql(600.0)}, {filled_sql(600.0)}
SELECT day, window_index, {doubles('window_start')}, dominant_family, {bigs('flow_count')}, {doubles('byte_rate', 'dstip_entropy')},
 {bigs('attack_flows')}, {doubles('attack_ratio')} FROM filled"""


def base(spark, sf, cfg=HOURLY):
    rows = ops.aggregate_windows(ops.assign_windows(view(spark, sf, "flows"), cfg), cfg)
    return progression.progression_states(ops.fill_idle(rows, cfg), cfg)


def states(spark, sf, cfg=HOURLY):
    return tidy(base(spark, sf, cfg), *BY, "dominant_family", "attack_ratio", "progression_state", "progression_idx", "y_attack")


def states_text(cfg):
    return f"""WITH {windows_sql(cfg.window_seconds)}, {filled_sql(cfg.window_seconds)}, {progression_sql(cfg)}
SELECT day, window_index, dominant_family, {doubles('attack_ratio')}, progression_state,
 {big(STATE_INDEX_SQL, 'progression_idx')}, {bigs('y_attack')} FROM prog"""


def kb_sql() -> str:
    rows = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in phases.KNOWLEDGE)
    return f"kb(fam, tactic, techniques, phase, conf, note) AS (VALUES {rows})"


def down_sql(conf: str, steps: str) -> str:
    level = f"(CASE {conf} WHEN 'Low' THEN 0 WHEN 'High' THEN 2 ELSE 1 END)"
    return f"(CASE greatest({level} - ({steps}), 0) WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END)"


def phase_sql(span: int, source: str = "prog", name: str = "phased") -> str:
    conf = "coalesce(conf, 'Low')"
    t = phases.TEXTS
    share = "printf('%.2f', attack_ratio)"
    return f"""{kb_sql()},
rst AS (SELECT *, sum(CASE WHEN progression_state = 'NORMAL' THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY window_index) AS rg FROM {source}),
prv AS (SELECT *, last_value(CASE WHEN y_attack = 1 THEN dominant_family END IGNORE NULLS) OVER
   (PARTITION BY day, rg ORDER BY window_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pf FROM rst),
joi AS (SELECT *, progression_state = 'PRE_ATTACK' AS p, dominant_family IN ('PortScan', 'Infiltration') AS rec,
   progression_state = 'CONTINUATION' AND pf IS NOT NULL AND pf <> dominant_family AND dominant_family <> 'BENIGN' AS turn
   FROM (SELECT * EXCLUDE (pos, len, prev) FROM prv) LEFT JOIN kb ON dominant_family = fam),
{name} AS (SELECT *,
 CASE WHEN progression_state = 'NORMAL' THEN 'None' WHEN p AND rec THEN 'Reconnaissance' WHEN p THEN 'Reconnaissance (inferred)' ELSE coalesce(tactic, 'Unknown') END AS attck_tactic,
 CASE WHEN progression_state = 'NORMAL' THEN '' WHEN p AND rec THEN 'T1595;T1590' WHEN p THEN 'T1590' ELSE coalesce(techniques, '') END AS attck_techniques,
 CASE WHEN progression_state = 'NORMAL' THEN 'None' WHEN p THEN 'Reconnaissance' ELSE coalesce(phase, 'Unknown') END AS attck_phase,
 CASE WHEN progression_state = 'NORMAL' THEN 'High' WHEN p AND rec THEN 'Medium' WHEN p THEN 'Low'
      WHEN progression_state = 'ACTIVE' AND attack_ratio >= 0.15 THEN {conf} ELSE {down_sql(conf, '1')} END AS attck_confidence,
 CASE WHEN turn THEN pf || ' -> ' || dominant_family END AS attck_family_transition,
 CASE WHEN progression_state = 'NORMAL' THEN '{t['NORMAL']}'
  WHEN p AND rec THEN replace(replace('{t['PRE_RECON']}', '%d', '{span}'), '%s', dominant_family)
  WHEN p THEN replace('{t['PRE_OTHER']}', '%s', dominant_family)
  WHEN progression_state = 'ONSET' THEN 'first window carrying a confirmed ' || dominant_family || ' label; tactic per knowledge base but downgraded - single-window evidence (attack_ratio=' || {share} || ')'
  WHEN progression_state = 'ACTIVE' THEN 'sustained ' || dominant_family || ' activity (attack_ratio=' || {share} || '); ' || coalesce(note, '{phases.UNKNOWN[4]}')
  WHEN turn THEN 'tactic transition ' || pf || ' -> ' || dominant_family || '; adversary changed technique within the same episode'
  ELSE dominant_family || ' episode tail (attack_ratio=' || {share} || '); activity persisting or winding down' END AS attck_rationale
 FROM joi)"""


PHASE_COLUMNS = ["attck_tactic", "attck_techniques", "attck_phase", "attck_confidence", "attck_family_transition", "attck_rationale"]


def phased(spark, sf):
    return tidy(phases.window_phases(base(spark, sf), HOURLY), *BY, "progression_state", *PHASE_COLUMNS)


PHASED = f"""WITH {windows_sql()}, {filled_sql()}, {progression_sql()}, {phase_sql(HOURLY.pre_attack_span)}
SELECT day, window_index, progression_state, {', '.join(PHASE_COLUMNS)} FROM phased"""


def confidence(spark, sf):
    return tidy(reports.phase_confidence(phases.window_phases(base(spark, sf), HOURLY)))


CONFIDENCE = f"SELECT attck_phase, attck_confidence, {big('count(*)', 'windows')} FROM ({PHASED}) GROUP BY 1, 2"


def sessions(spark, sf):
    return view(spark, sf, "flows").withColumn("session_id", F.col("protocol").cast("string"))


def closed(spark, sf):
    """The live window aggregation on the whole table, sizes counted exactly; one session per protocol."""
    rows = live.closed_windows(sessions(spark, sf), HOURLY, 0.0, size_step=None)
    return tidy(rows.select("session_id", "window_index", "window_start", *[F.round(f, 9).alias(f) for f in live.STREAM_FEATURES]))


CLOSED_CTES = f"""flows AS ({duck('flows')}), aw AS (SELECT * REPLACE (CAST(protocol AS VARCHAR) AS day),
  CAST(floor(flow_start_epoch / 3600.0::DOUBLE) AS BIGINT) AS window_index, floor(flow_start_epoch / 3600.0::DOUBLE) * 3600.0::DOUBLE AS window_start FROM flows),
{windows_sql()[len(assigned_sql()) + 1:]}"""
CLOSED = f"""WITH {CLOSED_CTES}
SELECT day AS session_id, window_index, {doubles('window_start')}, {', '.join(r6(f"round({f}, 9)", f) for f in live.STREAM_FEATURES)} FROM win"""


def full(spark, sf):
    return tidy(state_windows(view(spark, sf, "flows"), HOURLY), *BY, "window_start", "progression_state", "y_attack",
                "dominant_family", "attck_phase", "attck_confidence", *FEATURES)


FULL = f"""WITH {windows_sql()}, {filled_sql()}, {progression_sql()}, {phase_sql(HOURLY.pre_attack_span)}, {time_sql(3600.0, 'phased')}
SELECT day, window_index, {doubles('window_start')}, progression_state, {bigs('y_attack')}, dominant_family, attck_phase,
 attck_confidence, {doubles(*FEATURES)} FROM timed"""


def epoch_buckets(spark, sf):
    flows = view(spark, sf, "flows").withColumn("source_file", F.concat(F.lit("sensor-"), (F.col("flow_id") % 4).cast("string")))
    return tidy(ops.epoch_windows(flows, 5))


EPOCH_BUCKETS = f"""WITH flows AS ({duck('flows')})
SELECT concat('sensor-', CAST(flow_id % 4 AS VARCHAR)) AS source_file, {big('floor(flow_start_epoch / 5)', 'timestamp_window')},
 {big('sum(fwd_pkts)', 'fwd_pkts_sum')}, {big('sum(bwd_pkts)', 'bwd_pkts_sum')}, {big('sum(retransmission_count)', 'retransmission_count_sum')},
 {r6('avg(pkt_ttl_mean)', 'pkt_ttl_mean_mean')}, {r6('stddev_samp(pkt_ttl_mean)', 'pkt_ttl_mean_std')},
 {r6('avg(pkt_win_mean)', 'pkt_win_mean_mean')}, {r6('stddev_samp(pkt_win_mean)', 'pkt_win_mean_std')},
 {r6('avg(pkt_payload_var)', 'pkt_payload_var_mean')}, {r6('avg(pkt_payload_skew)', 'pkt_payload_skew_mean')},
 {r6('avg(pkt_payload_kurtosis)', 'pkt_payload_kurtosis_mean')}, {r6('avg(pkt_payload_nonzero_ratio)', 'pkt_payload_nonzero_ratio_mean')},
 {big('max(frag_more_flag_present)', 'frag_more_flag_present_max')}, {big('max(frag_dont_flag_present)', 'frag_dont_flag_present_max')},
 {r6('max(port_scan_entropy)', 'port_scan_entropy_max')}, {big('max(unique_dst_ports_per_src)', 'unique_dst_ports_per_src_max')},
 {big('max(port_scan_max_sequential_run)', 'port_scan_max_sequential_run_max')}, {r6('max(port_scan_sequential_ratio)', 'port_scan_sequential_ratio_max')},
 {big('count(*)', 'flows_in_window')}
FROM flows GROUP BY 1, 2"""


ENTRIES = {
    "windows_tumbling": (tumbling, TUMBLING),
    "windows_sliding": (sliding, SLIDING),
    "windows_volume": (lambda s, d: volume(s, d, ["flow_count", *VOLUME]), volume_text(VOLUME, ["flow_count"])),
    "windows_flag_rates": (lambda s, d: volume(s, d, [*FLAGS, "failed_conn_ratio", "tcp_ratio", "udp_ratio"]),
                           volume_text([*FLAGS, "failed_conn_ratio", "tcp_ratio", "udp_ratio"])),
    "windows_timing": (lambda s, d: volume(s, d, TIMING), volume_text(TIMING)),
    "windows_packet_layer": (lambda s, d: volume(s, d, PACKET), volume_text(PACKET)),
    "windows_scan_signatures": (
        lambda s, d: volume(s, d, SCAN).withColumns({c: F.col(c).cast("double") for c in SCAN}), volume_text(SCAN)),
    "windows_attack_ratio": (lambda s, d: volume(s, d, ["attack_flows", "attack_ratio"]),
                             volume_text(["attack_ratio"], ["attack_flows"])),
    "windows_hosts": (hosts, HOSTS),
    "windows_port_entropy": (ports, PORTS),
    "windows_size_entropy": (sizes, SIZES),
    "windows_dominant_family": (dominant, DOMINANT),
    "windows_idle_filled": (idle, IDLE),
    "windows_progression": (states, states_text(HOURLY)),
    "windows_progression_10min": (lambda s, d: states(s, d, TEN_MINUTES), states_text(TEN_MINUTES)),
    "windows_phase_confidence": (confidence, CONFIDENCE),
    "stream_windows_closed": (closed, CLOSED),
    "windows_phases": (phased, PHASED),
    "state_windows": (full, FULL),
    "windows_epoch_buckets": (epoch_buckets, EPOCH_BUCKETS),
}
