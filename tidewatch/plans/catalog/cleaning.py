"""Cleaning, contract and label-transfer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import columns as C
from tidewatch.operators import clean, labels
from tidewatch.plans import serve
from tidewatch.plans.catalog.common import GRAIN, big, bigs, doubles, r6, tidy
from tidewatch.sources import contract
from tidewatch.sources.adapters import duck, view


def raw(spark, sf):
    return contract.apply_aliases(contract.trim_names(view(spark, sf, "raw_flows")))


def case_family(col: str) -> str:
    whens = " ".join(f"WHEN contains(lower(t), '{needle}') THEN '{fam}'" for needle, fam in C.LABEL_FAMILIES)
    return f"CASE WHEN t = '' THEN 'BENIGN' {whens} ELSE t END".replace("t =", f"trim(coalesce({col}, '')) =").replace(
        "lower(t)", f"lower(trim(coalesce({col}, '')))").replace("ELSE t END", f"ELSE trim({col}) END")


def number_sql(col: str) -> str:
    v = f"TRY_CAST({col} AS DOUBLE)"
    return f"CASE WHEN isfinite({v}) THEN {v} END"


DAY = ("CASE " + " ".join(f"WHEN contains(source_day, '{d}') THEN '{d}'" for d in
                          ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday")) + " ELSE 'Unknown' END")
RAW = f'raw0 AS ({duck("raw_flows")}), raw AS (SELECT * RENAME (" source_day" AS source_day, "row id" AS row_id, " Source Port" AS source_port) FROM raw0)'
FIT = f"cl AS (SELECT *, {DAY} AS day, coalesce({number_sql(chr(34) + 'Flow Bytes/s' + chr(34))}, 0) AS fb, coalesce({number_sql(chr(34) + 'Flow Packets/s' + chr(34))}, 0) AS fp FROM raw)"
LIMITS = "lim AS (SELECT quantile_cont(fb, 0.999) AS hb, quantile_cont(fp, 0.999) AS hp FROM cl WHERE day IN ('Monday', 'Tuesday', 'Wednesday'))"


def label_families(spark, sf):
    return tidy(clean.label_flows(raw(spark, sf)).groupBy("attack_family", "is_attack").agg(F.count(F.lit(1)).alias("flows")))


LABEL_FAMILIES = f"""WITH {RAW}, f AS (SELECT {case_family('"Label"')} AS attack_family FROM raw)
SELECT attack_family, {big("CASE WHEN attack_family <> 'BENIGN' THEN 1 ELSE 0 END", 'is_attack')}, {big('count(*)', 'flows')} FROM f GROUP BY 1, 2"""


def label_by_day(spark, sf):
    rows = clean.assign_day(clean.label_flows(raw(spark, sf)))
    return tidy(rows.groupBy("day", "attack_family").agg(F.count(F.lit(1)).alias("flows")))


LABEL_BY_DAY = f"""WITH {RAW} SELECT {DAY} AS day, {case_family('"Label"')} AS attack_family, {big('count(*)', 'flows')} FROM raw GROUP BY 1, 2"""


def cleaned(spark, sf):
    rows = raw(spark, sf).withColumn("flow_start_epoch", contract.parse_timestamp(F.col("Timestamp")))
    rows = clean.clean_flows(rows)
    return tidy(rows.select(
        F.col("row id").alias("row_id"), "day", "flow_start_epoch", "attack_family", "is_attack",
        F.col("Source IP").alias("src_ip"), F.col("Source Port").alias("src_port"), F.col("Destination Port").alias("dst_port"),
        F.col("Protocol").alias("protocol"), F.col("Flow Duration").alias("flow_duration"),
        F.col("Total Length of Bwd Packets").alias("bwd_bytes"), F.col("Flow Bytes/s").alias("flow_bytes_s"),
        F.col("Flow Packets/s").alias("flow_packets_s")))


CLEANED = f"""WITH {RAW}, {FIT}, {LIMITS}
SELECT row_id, day, {r6("epoch_us(strptime(Timestamp, '%d/%m/%Y %H:%M:%S')) / 1000000.0::DOUBLE", 'flow_start_epoch')},
 {case_family('"Label"')} AS attack_family,
 CAST(CASE WHEN {case_family('"Label"')} <> 'BENIGN' THEN 1 ELSE 0 END AS BIGINT) AS is_attack, "Src IP" AS src_ip,
 {big(f"coalesce({number_sql('source_port')}, 0)", 'src_port')}, {big(f"coalesce({number_sql(chr(34) + 'Destination Port' + chr(34))}, 0)", 'dst_port')},
 {big('"Protocol"', 'protocol')}, {r6(f"coalesce({number_sql(chr(34) + 'Flow Duration' + chr(34))}, 0)", 'flow_duration')},
 {r6(f"coalesce({number_sql(chr(34) + 'TotLen Bwd Pkts' + chr(34))}, 0)", 'bwd_bytes')},
 {r6('least(fb, hb)', 'flow_bytes_s')}, {r6('least(fp, hp)', 'flow_packets_s')} FROM cl, lim"""


def limits(spark, sf):
    rows = clean.coerce_numbers(clean.assign_day(raw(spark, sf)), ["Flow Bytes/s", "Flow Packets/s"])
    return tidy(clean.rate_limits(rows))


LIMITS_SQL = f"""WITH {RAW}, {FIT}, {LIMITS}
SELECT 'Flow Bytes/s' AS "column", {r6('hb', 'high')} FROM lim UNION ALL SELECT 'Flow Packets/s', {r6('hp', 'high')} FROM lim"""


def fixed(spark, sf):
    got = clean.fixed_cells(raw(spark, sf))
    return tidy(got.select(F.col("Flow Bytes/s").alias("flow_bytes_s"), F.col("Flow Packets/s").alias("flow_packets_s"),
                           F.col("Total Length of Bwd Packets").alias("bwd_bytes"), "all_columns"))


def _nulls(col):
    return f"sum(CASE WHEN ({number_sql(col)}) IS NULL THEN 1 ELSE 0 END)"


FIXED = f"""WITH {RAW} SELECT {big(_nulls('"Flow Bytes/s"'), 'flow_bytes_s')}, {big(_nulls('"Flow Packets/s"'), 'flow_packets_s')},
 {big(_nulls('"TotLen Bwd Pkts"'), 'bwd_bytes')},
 {big(' + '.join(_nulls(f'"{c}"') for c in ('Flow Bytes/s', 'Flow Packets/s', 'TotLen Bwd Pkts', 'TotLen Fwd Pkts', 'Tot Fwd Pkts', 'Tot Bwd Pkts', 'Flow Duration', 'Flow IAT Mean', 'SYN Flag Count', 'RST Flag Count')), 'all_columns')} FROM raw"""


def upload(spark, sf):
    rows = contract.to_engine(contract.normalise_upload(view(spark, sf, "raw_flows")))
    return tidy(rows.select(
        F.col("row id").alias("row_id"), "flow_start_epoch", "src_ip", "dst_ip", "fwd_pkts", "bwd_pkts",
        "flag_syn", "flag_rst", "flag_fin", "attack_family", "is_attack", "day"))


UPLOAD = f"""WITH {RAW} SELECT row_id, {r6("epoch_us(strptime(Timestamp, '%d/%m/%Y %H:%M:%S')) / 1000000.0::DOUBLE", 'flow_start_epoch')},
 "Src IP" AS src_ip, "Dst IP" AS dst_ip, "Tot Fwd Pkts" AS fwd_pkts, "Tot Bwd Pkts" AS bwd_pkts,
 {big('CASE WHEN TRY_CAST("SYN Flag Count" AS DOUBLE) > 0 THEN 1 ELSE 0 END', 'flag_syn')},
 {big('CASE WHEN TRY_CAST("RST Flag Count" AS DOUBLE) > 0 THEN 1 ELSE 0 END', 'flag_rst')}, {big('0', 'flag_fin')},
 'BENIGN' AS attack_family, {big('0', 'is_attack')}, 'upload' AS day FROM raw"""


def upload_states(spark, sf):
    """An uploaded text table through contract, cleaning and windows."""
    return tidy(serve.upload_windows(view(spark, sf, "raw_flows"), GRAIN).select(
        "day", "window_index", "window_start", "progression_state", "flow_count", "packet_count", "byte_count", "unique_src", "unique_dst",
        "failed_conn_ratio", "syn_rate", "time_since_prev_window", "d_packet_rate"))


def _number(name: str) -> str:
    return f"""coalesce(CASE WHEN isfinite(TRY_CAST("{name}" AS DOUBLE)) THEN TRY_CAST("{name}" AS DOUBLE) END, 0)"""


UPLOAD_STATES = f"""WITH {RAW}, up AS (SELECT epoch_us(strptime(Timestamp, '%d/%m/%Y %H:%M:%S')) / 1000000.0::DOUBLE AS e, "Src IP" AS s, "Dst IP" AS d,
  {_number('Tot Fwd Pkts')} + {_number('Tot Bwd Pkts')} AS pk, {_number('TotLen Fwd Pkts')} + {_number('TotLen Bwd Pkts')} AS oc,
  CASE WHEN TRY_CAST("SYN Flag Count" AS DOUBLE) > 0 THEN 1 ELSE 0 END AS syn, CASE WHEN TRY_CAST("RST Flag Count" AS DOUBLE) > 0 THEN 1 ELSE 0 END AS rst FROM raw),
o AS (SELECT min(e) AS t0 FROM up),
w AS (SELECT CAST(floor((e - t0) / 3600) AS BIGINT) AS window_index, min(t0 + floor((e - t0) / 3600) * 3600) AS window_start, count(*) AS n, sum(pk) AS pk, sum(oc) AS oc,
  count(DISTINCT s) AS us, count(DISTINCT d) AS ud, avg(rst) AS fc, sum(syn) / 3600.0::DOUBLE AS sy FROM up, o GROUP BY 1),
g AS (SELECT window_index, window_start, lead(window_index) OVER (ORDER BY window_index) AS nx FROM w),
a AS (SELECT window_index, window_start FROM w UNION ALL SELECT i, window_start + (i - window_index) * 3600 FROM
  (SELECT window_index, window_start, unnest(generate_series(window_index + 1, nx - 1)) AS i FROM g WHERE nx - window_index > 1 AND nx - window_index <= 61)),
f AS (SELECT a.window_index, a.window_start, coalesce(n, 0) AS n, coalesce(pk, 0) AS pk, coalesce(oc, 0) AS oc, coalesce(us, 0) AS us, coalesce(ud, 0) AS ud,
  coalesce(fc, 0) AS fc, coalesce(sy, 0) AS sy FROM a LEFT JOIN w ON w.window_index = a.window_index)
SELECT 'upload' AS day, {bigs('window_index')}, {doubles('window_start')}, 'NORMAL' AS progression_state, {r6('n', 'flow_count')}, {r6('pk', 'packet_count')},
 {r6('oc', 'byte_count')}, {r6('us', 'unique_src')}, {r6('ud', 'unique_dst')}, {r6('fc', 'failed_conn_ratio')}, {r6('sy', 'syn_rate')},
 {r6('coalesce(window_start - lag(window_start) OVER (ORDER BY window_index), 3600)', 'time_since_prev_window')},
 {r6('coalesce((pk - lag(pk) OVER (ORDER BY window_index)) / 3600.0::DOUBLE, 0)', 'd_packet_rate')} FROM f"""


def non_finite(spark, sf):
    got = clean.non_finite_cells(raw(spark, sf))
    return tidy(got.select(F.col("Flow Bytes/s").alias("flow_bytes_s"), F.col("Flow Packets/s").alias("flow_packets_s")))


NON_FINITE = f"""WITH {RAW} SELECT {big(_nulls('"Flow Bytes/s"'), 'flow_bytes_s')}, {big(_nulls('"Flow Packets/s"'), 'flow_packets_s')} FROM raw"""


def summary(spark, sf):
    from tidewatch.operators.reports import upload_summary
    return tidy(upload_summary(view(spark, sf, "flows")))


SUMMARY = f"""WITH flows AS ({duck('flows')})
SELECT {big('count(*)', 'rows')}, {r6('max(flow_start_epoch) - min(flow_start_epoch)', 'span_seconds')},
 {big('floor((max(flow_start_epoch) - min(flow_start_epoch)) / 10)', 'est_windows')} FROM flows"""


def histograms(spark, sf):
    from tidewatch.operators.reports import upload_histograms
    return tidy(upload_histograms(view(spark, sf, "flows"), "attack_family"))


HISTOGRAMS = f"""WITH flows AS ({duck('flows')})
SELECT 'family' AS kind, attack_family AS value, {big('count(*)', 'rows')} FROM flows GROUP BY 2
UNION ALL SELECT 'protocol', CASE protocol WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE CAST(protocol AS VARCHAR) END, {big('count(*)', 'rows')} FROM flows GROUP BY 2"""


def top(spark, sf):
    from tidewatch.operators.reports import top_values, upload_histograms
    return tidy(top_values(upload_histograms(view(spark, sf, "flows"), "attack_family"), 5))


TOP = f"SELECT * FROM ({HISTOGRAMS}) ORDER BY rows DESC, value LIMIT 5"


def sample(spark, sf):
    flows = view(spark, sf, "flows")
    # 2024-01-05 .. 2024-01-20
    return tidy(clean.systematic_sample(flows, "flow_start_epoch", 1704412800.0, 1705708800.0, 500, ["flow_id"])
                .select("flow_id", "day", "flow_start_epoch", "attack_family"))


SAMPLE = f"""WITH flows AS ({duck('flows')}),
w AS (SELECT *, row_number() OVER (ORDER BY flow_start_epoch, flow_id) - 1 AS p, count(*) OVER () AS n FROM flows
  WHERE flow_start_epoch >= 1704412800 AND flow_start_epoch < 1705708800)
SELECT flow_id, day, {doubles('flow_start_epoch')}, attack_family FROM w WHERE p % greatest(1, CAST(floor(n / 500.0) AS BIGINT)) = 0"""


def keys(spark, sf):
    p = view(spark, sf, "packets")
    key = C.endpoint_key(F.col("src_ip"), F.col("sport"), F.col("dst_ip"), F.col("dport"), F.col("proto"))
    return tidy(p.groupBy(key.alias("canon_key")).agg(F.count(F.lit(1)).alias("packets")))


KEYS = f"""WITH p AS ({duck('packets')}),
e AS (SELECT src_ip || ':' || sport AS a, dst_ip || ':' || dport AS b, proto FROM p)
SELECT least(a, b) || '<->' || greatest(a, b) || ':' || proto AS canon_key, {big('count(*)', 'packets')} FROM e GROUP BY 1"""


def flow_ids(spark, sf):
    p = view(spark, sf, "packets").withColumns({
        "src_ip": F.concat(F.lit("192."), (F.col("pkt_id") % 256).cast("string"), F.lit(".7."), (F.col("pkt_id") % 3).cast("string")),
        "dst_ip": F.concat(F.lit("192."), (F.col("pkt_id") * 7 % 256).cast("string"), F.lit(".7."), (F.col("pkt_id") % 5).cast("string"))})
    fid = C.signed_flow_id(F.col("src_ip"), F.col("sport"), F.col("dst_ip"), F.col("dport"), F.col("proto"))
    return tidy(p.select("pkt_id", fid.alias("flow_id")))


_SB = "list_transform(string_split({0}, '.'), lambda x: CASE WHEN CAST(x AS INT) < 128 THEN CAST(x AS INT) ELSE CAST(x AS INT) - 256 END)"
FLOW_IDS = f"""WITH p0 AS ({duck('packets')}), p AS (SELECT * REPLACE (
  '192.' || (pkt_id % 256) || '.7.' || (pkt_id % 3) AS src_ip, '192.' || (pkt_id * 7 % 256) || '.7.' || (pkt_id % 5) AS dst_ip) FROM p0),
b AS (SELECT *, {_SB.format('src_ip')} AS sb, {_SB.format('dst_ip')} AS db FROM p)
SELECT pkt_id, CASE WHEN sb < db OR (sb = db AND sport < dport)
  THEN concat_ws('-', src_ip, dst_ip, sport, dport, proto) ELSE concat_ws('-', dst_ip, src_ip, dport, sport, proto) END AS flow_id FROM b"""


def filtered(spark, sf):
    p = view(spark, sf, "packets")
    wanted = (clean.packet_filter(protocol=6, port=443) & ~clean.packet_filter(host="10.1.0.3")) | clean.packet_filter(protocol=17, skip_broadcast=True)
    return tidy(p.where(wanted).groupBy("proto").agg(F.count(F.lit(1)).alias("packets"), F.sum("payload_len").alias("payload")))


FILTERED = f"""WITH p AS ({duck('packets')}) SELECT CAST(proto AS BIGINT) AS proto, {big('count(*)', 'packets')}, {r6('sum(payload_len)', 'payload')} FROM p
WHERE (proto = 6 AND (sport = 443 OR dport = 443) AND NOT (src_ip = '10.1.0.3' OR dst_ip = '10.1.0.3'))
 OR (proto = 17 AND dst_ip <> '255.255.255.255' AND CAST(split_part(dst_ip, '.', 1) AS INT) NOT BETWEEN 224 AND 239) GROUP BY 1"""


# ---- label transfer -------------------------------------------------------

def sides(spark, sf):
    left = view(spark, sf, "unlabelled").withColumn("kind", F.col("true_type"))
    right = view(spark, sf, "labelled_ref").withColumn("kind", F.col("label"))
    return left, right


def matched(spark, sf):
    left, right = sides(spark, sf)
    got = labels.transfer_labels(left, right, ["canon_key", "t_sec", "kind"], ["canon_key", "t_sec"], "canon_key", "t_sec",
                                 2, "flow_row_id", "orig_id")
    return left, right, got


def pair_sql(name, left, right, keys):
    ks = ", ".join(keys)
    return f"""{name} AS (SELECT l.flow_row_id, r.orig_id, r.label FROM
 (SELECT {ks}, min(flow_row_id) AS flow_row_id FROM {left} GROUP BY ALL) l JOIN
 (SELECT {ks}, min(orig_id) AS orig_id, arg_min(label, orig_id) AS label FROM {right} GROUP BY {ks}) r USING ({ks}))"""


def transfer_sql(left: str, right: str, exact: list[str], loose: list[str]) -> str:
    """CTEs up to ``mm``, the pairs of the three stages; both sides have their id, ``canon_key`` and ``t_sec``."""
    return f"""l0 AS ({left}), r0 AS ({right}),
{pair_sql('m1', 'l0', 'r0', exact)},
l1 AS (SELECT * FROM l0 WHERE flow_row_id NOT IN (SELECT flow_row_id FROM m1)), r1 AS (SELECT * FROM r0 WHERE orig_id NOT IN (SELECT orig_id FROM m1)),
{pair_sql('m2', 'l1', 'r1', loose)},
l2 AS (SELECT * FROM l1 WHERE flow_row_id NOT IN (SELECT flow_row_id FROM m2)), r2 AS (SELECT * FROM r1 WHERE orig_id NOT IN (SELECT orig_id FROM m2)),
cand AS (SELECT l.flow_row_id, l.t_sec, r.orig_id, r.label, abs(l.t_sec - r.t_sec) AS gap, CASE WHEN r.t_sec <= l.t_sec THEN 0 ELSE 1 END AS side
  FROM l2 l JOIN r2 r ON l.canon_key = r.canon_key AND r.t_sec BETWEEN l.t_sec - 2 AND l.t_sec + 2),
near AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY flow_row_id ORDER BY gap, side, CASE WHEN side = 0 THEN -orig_id ELSE orig_id END) = 1),
m3 AS (SELECT flow_row_id, orig_id, label FROM near QUALIFY row_number() OVER (PARTITION BY orig_id ORDER BY t_sec, flow_row_id) = 1),
mm AS (SELECT *, 1 AS stage FROM m1 UNION ALL SELECT *, 2 FROM m2 UNION ALL SELECT *, 3 FROM m3)"""


TRANSFER = "WITH " + transfer_sql(
    f"SELECT *, true_type AS kind FROM ({duck('unlabelled')})", f"SELECT *, label AS kind FROM ({duck('labelled_ref')})",
    ["canon_key", "t_sec", "kind"], ["canon_key", "t_sec"])


def nearest(spark, sf):
    left, right = sides(spark, sf)
    got = labels.nearest_in_time(left, right, "canon_key", "t_sec", 2, "flow_row_id", "orig_id", ["label"])
    return tidy(got.select("flow_row_id", "orig_id", "label"))


NEAREST = f"""WITH l AS ({duck('unlabelled')}), r AS ({duck('labelled_ref')}),
cand AS (SELECT l.flow_row_id, r.orig_id, r.label, abs(l.t_sec - r.t_sec) AS gap, CASE WHEN r.t_sec <= l.t_sec THEN 0 ELSE 1 END AS side
  FROM l JOIN r ON l.canon_key = r.canon_key AND r.t_sec BETWEEN l.t_sec - 2 AND l.t_sec + 2)
SELECT flow_row_id, orig_id, label FROM cand
QUALIFY row_number() OVER (PARTITION BY flow_row_id ORDER BY gap, side, CASE WHEN side = 0 THEN -orig_id ELSE orig_id END) = 1"""


def attached(spark, sf):
    left, _, got = matched(spark, sf)
    return tidy(labels.attach_labels(left, got, "flow_row_id").groupBy("true_type", "label").agg(F.count(F.lit(1)).alias("flows")))


def covered(spark, sf):
    left, right, got = matched(spark, sf)
    return tidy(labels.coverage(left, right, got))


ENTRIES = {
    "label_families": (label_families, LABEL_FAMILIES),
    "label_by_day": (label_by_day, LABEL_BY_DAY),
    "flows_cleaned": (cleaned, CLEANED),
    "rate_limits": (limits, LIMITS_SQL),
    "fixed_cells": (fixed, FIXED),
    "non_finite_cells": (non_finite, NON_FINITE),
    "upload_normalised": (upload, UPLOAD),
    "upload_windows": (upload_states, UPLOAD_STATES),
    "upload_summary": (summary, SUMMARY),
    "upload_histograms": (histograms, HISTOGRAMS),
    "upload_top_values": (top, TOP),
    "systematic_sample": (sample, SAMPLE),
    "endpoint_keys": (keys, KEYS),
    "signed_flow_ids": (flow_ids, FLOW_IDS),
    "packet_filter": (filtered, FILTERED),
    "label_transfer": (lambda s, d: tidy(matched(s, d)[2]),
                       f"{TRANSFER} SELECT {bigs('flow_row_id', 'orig_id')}, label, {bigs('stage')} FROM mm"),
    "nearest_in_time": (nearest, NEAREST),
    "labels_attached": (attached, f"""{TRANSFER} SELECT true_type, coalesce(label, 'BENIGN') AS label, {big('count(*)', 'flows')}
 FROM l0 LEFT JOIN mm USING (flow_row_id) GROUP BY 1, 2"""),
    "label_histogram": (lambda s, d: tidy(labels.label_histogram(matched(s, d)[2])),
                        f"{TRANSFER} SELECT label, {big('count(*)', 'rows')} FROM mm GROUP BY 1"),
    "label_coverage": (covered, f"""{TRANSFER}, n AS (SELECT (SELECT count(*) FROM l0) AS flow_rows, (SELECT count(*) FROM r0) AS label_rows, (SELECT count(*) FROM mm) AS matched)
SELECT {bigs('flow_rows', 'label_rows', 'matched')}, {r6('matched * 100.0::DOUBLE / label_rows', 'pct_labels_matched')}, {r6('matched * 100.0::DOUBLE / flow_rows', 'pct_flows_matched')} FROM n"""),
}
