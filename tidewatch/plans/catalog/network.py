"""Packet, flow-assembly and host-graph queries."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tidewatch.operators import assembler, graph, packets
from tidewatch.operators import windows as ops
from tidewatch.plans.catalog.common import HOURLY, SHORT, assigned_sql, big, bigs, doubles, r6, tidy
from tidewatch.plans.catalog.windows import BY, hourly
from tidewatch.sources.adapters import duck, view

# ---- packets ---------------------------------------------------------------


def cleaned(spark, sf):
    rows = packets.clean_packets(view(spark, sf, "raw_packets"), keep=("pkt_id",))
    return tidy(rows.drop("ts"))


def _num(c, d=0):
    return f"coalesce(TRY_CAST(\"{c}\" AS DOUBLE), {d})"


_PROTO = "CASE WHEN tcp THEN {0} WHEN udp THEN {1} ELSE {2} END"
_FLAGS = ("CASE WHEN \"tcp.flags\" = '0x0012' THEN 18 WHEN \"tcp.flags\" = '0x00C1' THEN 193 ELSE coalesce(TRY_CAST(\"tcp.flags\" AS BIGINT), 0) END")
CLEANED = f"""WITH raw AS ({duck('raw_packets')}), r AS (SELECT *, "tcp.srcport" <> '' AS tcp, "tcp.srcport" = '' AND "udp.srcport" <> '' AS udp, {_FLAGS} AS fl,
  TRY_CAST("frame.time_epoch" AS DOUBLE) AS ts FROM raw WHERE "ip.src" <> '')
SELECT pkt_id, {big('round_even(ts * 1000000, 0)', 'ts_us')}, "ip.src" AS src_ip, "ip.dst" AS dst_ip,
 {big(_PROTO.format(_num('tcp.srcport'), _num('udp.srcport'), 0), 'sport')}, {big(_PROTO.format(_num('tcp.dstport'), _num('udp.dstport'), 0), 'dport')},
 {big(_PROTO.format(6, 17, 0), 'proto')}, tcp AS is_tcp, NOT tcp AND NOT udp AS is_other, {r6(_num('frame.len'), 'frame_len')}, {r6(_num('ip.ttl'), 'ttl')},
 {r6(_PROTO.format(_num('tcp.len'), f"greatest({_num('udp.length', 8)} - 8, 0)", 0), 'payload_len')}, {r6(_PROTO.format(_num('tcp.hdr_len', 20), 8, 0), 'header_len')},
 {r6(f"CASE WHEN tcp THEN {_num('tcp.window_size_value')} ELSE -1 END", 'tcp_window')}, "ip.flags.mf" = '1' AS more_frag, "ip.flags.df" = '1' AS dont_frag,
 {r6(_num('ip.frag_offset'), 'frag_offset')}, "tcp.analysis.retransmission" = '1' AS is_retx,
 {', '.join(big(f'CASE WHEN tcp AND fl & {b} <> 0 THEN 1 ELSE 0 END', f) for f, b in packets.FLAG_BITS.items())}
FROM r WHERE ts IS NOT NULL"""


def dense(spark, sf):
    return view(spark, sf, "dense_packets").withColumn("ts", F.col("ts_us") / 1e6)


DENSE = f"dp0 AS ({duck('dense_packets')}), dp AS (SELECT *, ts_us / 1000000.0::DOUBLE AS ts FROM dp0)"


def simple(spark, sf):
    rows = packets.simple_flows(dense(spark, sf))
    return tidy(rows.withColumnsRenamed({"Fwd IAT Total": "fwd_iat_total", "Bwd IAT Total": "bwd_iat_total"}))


SIMPLE = f"""WITH {DENSE}, k AS (SELECT *, least(src_ip || ':' || sport, dst_ip || ':' || dport) || '|' || greatest(src_ip || ':' || sport, dst_ip || ':' || dport) || '|' || proto AS key FROM dp),
f AS (SELECT *, first_value(src_ip) OVER w AS s, first_value(sport) OVER w AS sp, first_value(dst_ip) OVER w AS d, first_value(dport) OVER w AS dpo FROM k
   WINDOW w AS (PARTITION BY key ORDER BY ts, pkt_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, src_ip = s AND sport = sp AS fwd, ts - lag(ts) OVER (PARTITION BY key, src_ip = s AND sport = sp ORDER BY ts, pkt_id) AS gp FROM f),
a AS (SELECT s AS src_ip, d AS dst_ip, sp AS src_port, dpo AS dst_port, proto, min(ts) AS t0, (max(ts) - min(ts)) * 1000000 AS span, count(*) AS n, count(*) FILTER (fwd) AS fwd_pkts,
  coalesce(sum(frame_len) FILTER (fwd), 0) AS fwd_bytes, sum(frame_len) AS octets, coalesce(sum(gp) FILTER (fwd), 0) * 1000000 AS fi, coalesce(sum(gp) FILTER (NOT fwd), 0) * 1000000 AS bi,
  {', '.join(f"max(CASE WHEN {x} <> 0 AND proto = 6 THEN 1 ELSE 0 END) AS flag_{x}" for x in ('fin', 'syn', 'rst', 'psh', 'ack', 'urg'))} FROM g GROUP BY key, 1, 2, 3, 4, 5)
SELECT src_ip, dst_ip, {bigs('src_port', 'dst_port')}, {big('proto', 'protocol')}, {r6('round(t0, 6)', 'flow_start_epoch')}, {r6('round(span, 1)', 'flow_duration')},
 {r6('round(span / greatest(n - 1, 1), 3)', 'flow_iat_mean')}, {bigs('fwd_pkts')}, {big('n - fwd_pkts', 'bwd_pkts')}, {doubles('fwd_bytes')}, {r6('octets - fwd_bytes', 'bwd_bytes')},
 {r6('round(fi, 1)', 'fwd_iat_total')}, {r6('round(bi, 1)', 'bwd_iat_total')}, {r6('round(octets / n, 2)', 'pkt_len_mean')}, {bigs(*[f'flag_{x}' for x in ('fin', 'syn', 'rst', 'psh', 'ack', 'urg')])} FROM a"""


def scans(spark, sf):
    rows = view(spark, sf, "dense_packets").withColumns({
        "ts": F.col("ts_us") / 1e6, "src_ip": F.concat(F.lit("h"), (F.col("pkt_id") % 3).cast("string")),
        "dport": (F.col("pkt_id") / 3).cast("int") % 11 + F.when(F.col("pkt_id") % 13 == 0, 5).otherwise(0)})
    return tidy(packets.scan_statistics(rows, ["pkt_id"], seconds=60))


SCANS = f"""WITH {DENSE}, q AS (SELECT 'h' || (pkt_id % 3) AS src_ip, CAST(floor(ts / 60) AS BIGINT) AS timestamp_window, ts, pkt_id,
  CAST(pkt_id // 3 AS INT) % 11 + CASE WHEN pkt_id % 13 = 0 THEN 5 ELSE 0 END AS dport FROM dp),
c AS (SELECT src_ip, timestamp_window, dport, CAST(count(*) AS DOUBLE) AS c FROM q GROUP BY 1, 2, 3),
p AS (SELECT *, c / sum(c) OVER (PARTITION BY src_ip, timestamp_window) AS p FROM c),
e AS (SELECT src_ip, timestamp_window, -sum(p * log2(p)) AS port_scan_entropy, count(*) AS unique_dst_ports_per_src FROM p GROUP BY 1, 2),
s AS (SELECT *, abs(dport - lag(dport) OVER w) AS st FROM q WINDOW w AS (PARTITION BY src_ip, timestamp_window ORDER BY ts, pkt_id)),
u AS (SELECT *, sum(CASE WHEN st = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY src_ip, timestamp_window ORDER BY ts, pkt_id) AS run FROM s),
r AS (SELECT src_ip, timestamp_window, run, count(*) FILTER (st = 1) AS sq, count(st) AS tr FROM u GROUP BY 1, 2, 3),
m AS (SELECT src_ip, timestamp_window, max(sq) AS port_scan_max_sequential_run, CASE WHEN sum(tr) > 0 THEN sum(sq) / CAST(sum(tr) AS DOUBLE) ELSE 0 END AS port_scan_sequential_ratio FROM r GROUP BY 1, 2)
SELECT src_ip, timestamp_window, {doubles('port_scan_entropy')}, {bigs('unique_dst_ports_per_src', 'port_scan_max_sequential_run')}, {doubles('port_scan_sequential_ratio')} FROM e JOIN m USING (src_ip, timestamp_window)"""


def enriched(spark, sf):
    p = dense(spark, sf)
    flows = packets.enrich_with_scans(packets.simple_flows(p), packets.scan_statistics(p, ["pkt_id"]))
    return tidy(flows.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "timestamp_window", "port_scan_entropy",
                             "unique_dst_ports_per_src", "port_scan_max_sequential_run"))


ENRICHED = f"""{SIMPLE.split('SELECT src_ip, dst_ip, CAST(src_port')[0]},
ps AS (SELECT src_ip, CAST(floor(ts / 5) AS BIGINT) AS tw, dport, CAST(count(*) AS DOUBLE) AS c FROM dp GROUP BY 1, 2, 3),
pp AS (SELECT *, c / sum(c) OVER (PARTITION BY src_ip, tw) AS p FROM ps), pe AS (SELECT src_ip, tw, -sum(p * log2(p)) AS en, count(*) AS ports FROM pp GROUP BY 1, 2)
SELECT a.src_ip, dst_ip, {bigs('src_port', 'dst_port')}, {big('proto', 'protocol')}, {big('floor(round(t0, 6) / 5)', 'timestamp_window')}, {r6('coalesce(en, 0)', 'port_scan_entropy')},
 {big('coalesce(ports, 0)', 'unique_dst_ports_per_src')}, {big('0', 'port_scan_max_sequential_run')} FROM a LEFT JOIN pe ON pe.src_ip = a.src_ip AND pe.tw = CAST(floor(round(t0, 6) / 5) AS BIGINT)"""


def shape(spark, sf):
    p = view(spark, sf, "packets").withColumn("host", F.col("src_ip"))
    return tidy(packets.moments(p, ["host"], "payload_len", "pl"))


SHAPE = f"""WITH p AS ({duck('packets')}), m AS (SELECT src_ip AS host, payload_len AS v, avg(payload_len) OVER (PARTITION BY src_ip) AS mu FROM p),
c AS (SELECT host, count(*) AS n, max(mu) AS mu, sum((v - mu) ** 2) AS m2, sum((v - mu) ** 3) AS m3, sum((v - mu) ** 4) AS m4, avg(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS nz, min(v) AS lo, max(v) AS hi FROM m GROUP BY 1)
SELECT host, {r6('mu', 'pl_mean')}, {r6('CASE WHEN n > 1 THEN m2 / (n - 1) ELSE 0 END', 'pl_var')}, {r6('CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) ELSE 0 END', 'pl_std')},
 {r6('CASE WHEN n >= 3 AND m2 > 0 THEN sqrt(n) * m3 / m2 ** 1.5 ELSE 0 END', 'pl_skew')}, {r6('CASE WHEN n >= 4 AND m2 > 0 THEN n * m4 / (m2 * m2) - 3 ELSE 0 END', 'pl_kurtosis')},
 {r6('nz', 'pl_nonzero_ratio')}, {r6('lo', 'pl_min')}, {r6('hi', 'pl_max')} FROM c"""

# ---- full assembler --------------------------------------------------------

FLOW_NUMBERS = ["flow_duration", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "Flow IAT Mean", "Flow IAT Std", "Fwd IAT Total", "Bwd IAT Max",
                "Packet Length Mean", "Packet Length Variance", "Average Packet Size", "Fwd Header Length", "min_seg_size_forward",
                "act_data_pkt_fwd", "Init_Win_bytes_forward", "Init_Win_bytes_backward", "Active Mean", "Idle Max", "flag_fin", "flag_rst",
                "pkt_ttl_mean", "retransmission_count", "Subflow Fwd Packets", "Down/Up Ratio", "SYN Flag Count"]


MICROS = ("flow_duration", "Flow IAT Mean", "Flow IAT Std", "Fwd IAT Total", "Bwd IAT Max", "Active Mean", "Idle Max")  # shown in milliseconds


def full(spark, sf, profile):
    return flow_rows(assembler.assemble(view(spark, sf, "dense_packets"), profile, chunk_seconds=3600.0))


def flow_rows(rows):
    names = {n: n.lower().replace(" ", "_").replace("/", "_") for n in FLOW_NUMBERS}
    return tidy(rows.select("src_ip", "dst_ip", "src_port", "dst_port", "protocol", "flow_start_epoch",
                            *[(F.col(f"`{n}`").cast("double") / (1e3 if n in MICROS else 1.0)).alias(a) for n, a in names.items()]))


def full_sql(profile: assembler.Profile, packets: str = duck("dense_packets")) -> str:
    closes = "p.fin <> 0" if profile.any_fin_closes else "(p.fin <> 0 AND NOT (p.same OR p.side = s.orient)) OR (p.rst <> 0 AND p.fin = 0)"
    drop = "false" if profile.any_fin_closes else "p.fin <> 0 AND (p.same OR p.side = s.orient) AND s.ffin > 0"
    ffin = "0" if profile.any_fin_closes else "CASE WHEN p.fin <> 0 AND (p.same OR p.side = s.orient) THEN 1 ELSE s.ffin END"
    renew = "s.closed OR p.ts_us - s.start_us > 120000000"
    upd = "true" if profile.subflow_every_packet else "NOT closed OR iat > 1000000"
    syn = "psh_n" if profile.permuted_flags else "syn_n"
    swap = "orient <> oside AND oip <> odip"
    sub = "n - 1" if profile.subflow_every_packet else "coalesce(subs, 0)"
    return f"""WITH RECURSIVE dp AS ({packets}),
pk AS (SELECT *, src_ip || ':' || sport AS a, dst_ip || ':' || dport AS b FROM dp),
pp AS (SELECT *, least(a, b) || '<->' || greatest(a, b) || ':' || proto AS key, CASE WHEN a > b THEN 1 ELSE 0 END AS side, src_ip = dst_ip AS same,
  row_number() OVER (PARTITION BY least(a, b), greatest(a, b), proto ORDER BY ts_us, pkt_id) AS rn FROM pk),
st AS (SELECT key, rn, pkt_id, ts_us AS start_us, pkt_id AS start_pid, side AS orient, true AS opener, false AS closed, 0 AS ffin, true AS keep FROM pp WHERE rn = 1
 UNION ALL SELECT p.key, p.rn, p.pkt_id, CASE WHEN {renew} THEN p.ts_us ELSE s.start_us END, CASE WHEN {renew} THEN p.pkt_id ELSE s.start_pid END,
  CASE WHEN s.closed THEN p.side ELSE s.orient END, {renew}, NOT ({renew}) AND ({closes}), CASE WHEN {renew} THEN 0 ELSE {ffin} END, ({renew}) OR NOT ({drop})
  FROM st s JOIN pp p ON p.key = s.key AND p.rn = s.rn + 1),
fl AS (SELECT pp.*, st.* EXCLUDE (key, rn, pkt_id), st.opener OR same OR side = orient AS fwd FROM st JOIN pp USING (pkt_id) WHERE keep),
g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY start_pid ORDER BY ts_us, pkt_id) AS iat,
  ts_us - lag(ts_us) OVER (PARTITION BY start_pid, fwd ORDER BY ts_us, pkt_id) AS liat FROM fl),
u0 AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY start_pid ORDER BY ts_us, pkt_id) AS ug FROM g WHERE opener OR ({upd})),
u1 AS (SELECT *, sum(CASE WHEN ug > 5000000 THEN 1 ELSE 0 END) OVER (PARTITION BY start_pid ORDER BY ts_us, pkt_id) AS act FROM u0),
u2 AS (SELECT start_pid, act, max(ts_us) - min(ts_us) AS len, max(CASE WHEN ug > 5000000 THEN ug END) AS idle FROM u1 GROUP BY 1, 2),
u3 AS (SELECT start_pid, coalesce(avg(len) FILTER (len > 0), 0) AS active_mean, coalesce(max(idle), 0) AS idle_max FROM u2 GROUP BY 1),
tw AS (SELECT start_pid, payload_len FROM g UNION ALL SELECT start_pid, payload_len FROM g WHERE opener),
ln AS (SELECT start_pid, avg(payload_len) AS lm, coalesce(var_samp(payload_len), 0) AS lv, sum(payload_len) AS ls FROM tw GROUP BY 1),
ag AS (SELECT start_pid, min(ts_us) AS t0, max(ts_us) - min(ts_us) AS dur, count(*) AS n, count(*) FILTER (fwd) AS fp, count(*) FILTER (NOT fwd) AS bp,
  coalesce(sum(payload_len) FILTER (fwd), 0) AS fb, coalesce(sum(payload_len) FILTER (NOT fwd), 0) AS bb, coalesce(avg(iat), 0) AS im, coalesce(stddev_samp(iat), 0) AS isd,
  coalesce(sum(liat) FILTER (fwd), 0) AS fit, coalesce(max(liat) FILTER (NOT fwd), 0) AS bix, coalesce(sum(header_len) FILTER (fwd), 0) AS fh, min(header_len) FILTER (fwd) AS ms,
  count(*) FILTER (fwd AND NOT opener AND payload_len >= 1) AS ad, arg_min(tcp_window, (ts_us, pkt_id)) AS fw, arg_max(tcp_window, (ts_us, pkt_id)) FILTER (NOT fwd) AS bw,
  sum(fin) AS fin_n, sum(rst) AS rst_n, sum(syn) AS syn_n, sum(psh) AS psh_n, avg(ttl) AS ttl, count(*) FILTER (is_tcp AND is_retx) AS rx, count(*) FILTER (NOT opener AND iat > 1000000) AS subs,
  arg_min(src_ip, (ts_us, pkt_id)) AS oip, arg_min(dst_ip, (ts_us, pkt_id)) AS odip, arg_min(sport, (ts_us, pkt_id)) AS osp, arg_min(dport, (ts_us, pkt_id)) AS odp,
  arg_min(side, (ts_us, pkt_id)) AS oside, max(orient) AS orient, max(proto) AS proto FROM g GROUP BY 1)
SELECT CASE WHEN {swap} THEN odip ELSE oip END AS src_ip, CASE WHEN {swap} THEN oip ELSE odip END AS dst_ip,
 {big(f'CASE WHEN {swap} THEN odp ELSE osp END', 'src_port')}, {big(f'CASE WHEN {swap} THEN osp ELSE odp END', 'dst_port')}, {big('proto', 'protocol')},
 {r6('t0 / 1000000.0::DOUBLE', 'flow_start_epoch')}, {r6('dur / 1000.0::DOUBLE', 'flow_duration')}, {r6('fp', 'fwd_pkts')}, {r6('bp', 'bwd_pkts')}, {r6('fb', 'fwd_bytes')}, {r6('bb', 'bwd_bytes')},
 {r6('im / 1000.0::DOUBLE', 'flow_iat_mean')}, {r6('isd / 1000.0::DOUBLE', 'flow_iat_std')}, {r6('fit / 1000.0::DOUBLE', 'fwd_iat_total')}, {r6('bix / 1000.0::DOUBLE', 'bwd_iat_max')}, {r6('lm', 'packet_length_mean')}, {r6('lv', 'packet_length_variance')},
 {r6('ls / n', 'average_packet_size')}, {r6('fh', 'fwd_header_length')}, {r6('ms', 'min_seg_size_forward')}, {r6('ad', 'act_data_pkt_fwd')}, {r6('fw', 'init_win_bytes_forward')},
 {r6(f'coalesce(bw, {profile.init_win_unset})', 'init_win_bytes_backward')}, {r6('active_mean / 1000.0::DOUBLE', 'active_mean')}, {r6('idle_max / 1000.0::DOUBLE', 'idle_max')}, {r6('fin_n', 'flag_fin')}, {r6('rst_n', 'flag_rst')},
 {r6('ttl', 'pkt_ttl_mean')}, {r6('rx', 'retransmission_count')}, {r6(f'CASE WHEN {sub} > 0 THEN fp // ({sub}) ELSE 0 END', 'subflow_fwd_packets')},
 {r6('CASE WHEN fp > 0 THEN bp // fp ELSE 0 END', 'down_up_ratio')}, {r6(syn, 'syn_flag_count')}
FROM ag JOIN ln USING (start_pid) JOIN u3 USING (start_pid) WHERE n > 1"""


# ---- host graph ------------------------------------------------------------

HOSTS = 12  # the test tables have at most 63 hosts per hour, so a smaller limit than 32 makes the cut visible

GRAPH = f"""{assigned_sql()},
dg0 AS (SELECT day, window_index, src_ip AS host FROM aw UNION ALL SELECT day, window_index, dst_ip FROM aw),
dg AS (SELECT day, window_index, host, count(*) AS degree FROM dg0 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY day, window_index ORDER BY count(*) DESC, host) <= {HOSTS}),
ke AS (SELECT a.* FROM aw a JOIN dg s ON s.day = a.day AND s.window_index = a.window_index AND s.host = a.src_ip JOIN dg d ON d.day = a.day AND d.window_index = a.window_index AND d.host = a.dst_ip)"""


def top(spark, sf):
    return tidy(graph.top_hosts(graph.port_edges(hourly(spark, sf), BY), BY, HOSTS))


def edges(spark, sf):
    return tidy(graph.window_graph(hourly(spark, sf), BY, HOSTS)[1])


def nodes(spark, sf):
    return tidy(graph.window_graph(hourly(spark, sf), BY, HOSTS)[0])


def _l(expr, name):
    return r6(f"ln(1 + coalesce({expr}, 0))", name)


NODES = f"""WITH {GRAPH},
o AS (SELECT day, window_index, src_ip AS host, count(*) AS fl, sum(fwd_bytes + bwd_bytes) AS by, sum(fwd_pkts + bwd_pkts) AS pk, sum(flag_syn) AS sy, sum(flag_rst) AS rs,
  count(DISTINCT dst_port) AS po, count(DISTINCT dst_ip) AS pe FROM ke GROUP BY 1, 2, 3),
i AS (SELECT day, window_index, dst_ip AS host, count(*) AS fl, sum(fwd_bytes + bwd_bytes) AS by, sum(fwd_pkts + bwd_pkts) AS pk, sum(flag_syn) AS sy, sum(flag_rst) AS rs FROM ke GROUP BY 1, 2, 3)
SELECT dg.day, dg.window_index, dg.host, {_l('o.fl', 'out_flows')}, {_l('i.fl', 'in_flows')}, {_l('o.by', 'out_bytes')}, {_l('i.by', 'in_bytes')}, {_l('o.pk', 'out_packets')},
 {_l('i.pk', 'in_packets')}, {_l('o.sy', 'out_syn')}, {_l('i.sy', 'in_syn')}, {_l('o.rs', 'out_rst')}, {_l('i.rs', 'in_rst')}, {_l('o.po', 'distinct_ports')}, {_l('o.pe', 'distinct_peers')},
 {r6("CASE WHEN dg.host LIKE '10.%' THEN 1 ELSE 0 END", 'internal')}, {_l('degree', 'degree')}
FROM dg LEFT JOIN o ON o.day = dg.day AND o.window_index = dg.window_index AND o.host = dg.host LEFT JOIN i ON i.day = dg.day AND i.window_index = dg.window_index AND i.host = dg.host"""


def history(spark, sf):
    assigned = hourly(spark, sf)
    nested = graph.nest_nodes(graph.window_graph(assigned, BY, HOSTS)[0], BY)
    anchors = assigned.groupBy(*BY).agg(F.count(F.lit(1)).alias("n"))
    got = graph.gather_history(anchors, nested, ["day"], SHORT.history)
    sizes = F.array_join(F.transform("graphs", lambda g: F.size(g).cast("string")), ",")
    heads = F.array_join(F.transform("graphs", lambda g: F.coalesce(F.get(g, F.lit(0))["host"], F.lit("-"))), ",")
    return tidy(got.select("day", "window_index", sizes.alias("sizes"), heads.alias("heads")))


HISTORY = f"""WITH {GRAPH}, ws AS (SELECT day, window_index, count(*) AS c, arg_min(host, (-degree, host)) AS h FROM dg GROUP BY 1, 2),
an AS (SELECT DISTINCT day, window_index FROM aw),
ex AS (SELECT an.day, an.window_index, u.o, coalesce(c, 0) AS c, coalesce(h, '-') AS h FROM an JOIN (SELECT unnest(generate_series({-(SHORT.history - 1)}, 0)) AS o) u ON true
  LEFT JOIN ws ON ws.day = an.day AND ws.window_index = an.window_index + u.o)
SELECT day, window_index, string_agg(CAST(c AS VARCHAR), ',' ORDER BY o) AS sizes, string_agg(h, ',' ORDER BY o) AS heads FROM ex GROUP BY 1, 2"""


def aligned(spark, sf):
    assigned = hourly(spark, sf)
    nested = graph.nest_nodes(graph.window_graph(assigned, BY, HOSTS)[0], BY)
    windows = ops.fill_idle(ops.volume_features(assigned, BY, HOURLY.window_seconds).withColumn("dominant_family", F.lit("BENIGN")), HOURLY)
    return tidy(graph.align(windows, nested, BY).select(*BY, F.size("nodes").alias("nodes")))


ALIGNED = f"""WITH {GRAPH}, w AS (SELECT DISTINCT day, window_index FROM aw), g AS (SELECT *, lead(window_index) OVER (PARTITION BY day ORDER BY window_index) AS nx FROM w),
s AS (SELECT day, window_index FROM w UNION ALL SELECT day, unnest(generate_series(window_index + 1, nx - 1)) FROM g WHERE nx - window_index > 1 AND nx - window_index <= 61),
c AS (SELECT day, window_index, count(*) AS n FROM dg GROUP BY 1, 2) SELECT s.day, s.window_index, {big('coalesce(n, 0)', 'nodes')} FROM s LEFT JOIN c ON c.day = s.day AND c.window_index = s.window_index"""


ENTRIES = {
    "packets_cleaned": (cleaned, CLEANED),
    "packet_moments": (shape, SHAPE),
    "scan_statistics": (scans, SCANS),
    "flows_simple": (simple, SIMPLE),
    "flows_scan_enriched": (enriched, ENRICHED),
    "flows_assembled_classic": (partial(full, profile=assembler.CLASSIC), full_sql(assembler.CLASSIC)),
    "flows_assembled_strict": (partial(full, profile=assembler.STRICT), full_sql(assembler.STRICT)),
    "graph_top_hosts": (top, f"WITH {GRAPH} SELECT day, window_index, host, {bigs('degree')} FROM dg"),
    "graph_edges": (edges, f"WITH {GRAPH} SELECT day, window_index, src_ip, dst_ip, {big('count(*)', 'flows')}, {r6('ln(1 + count(*))', 'weight')} FROM ke GROUP BY 1, 2, 3, 4"),
    "graph_nodes": (nodes, NODES),
    "graph_aligned": (aligned, ALIGNED),
    "graph_history": (history, HISTORY),
}
