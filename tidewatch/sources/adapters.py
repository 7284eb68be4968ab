"""Views of the ``events`` table in the shape of flows, packets, labels and scores.

The two dialects share one text; only the epoch expression differs. The DuckDB
text is used by the checks, the Spark text by the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ts is TIMESTAMP_NTZ: a difference to 1970 does not depend on the session time zone
SPARK_EPOCH = "(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1000000.0D)"
DUCK_EPOCH = "(epoch_us(ts) / 1000000.0::DOUBLE)"

FLOWS = """
SELECT event_id AS flow_id,
  CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day,
  {epoch} AS flow_start_epoch,
  concat('10.0.0.', CAST(user_id % 40 AS VARCHAR(20))) AS src_ip,
  concat('10.1.0.', CAST(event_id % 23 AS VARCHAR(20))) AS dst_ip,
  1024 + event_id % 60000 AS src_port,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS dst_port,
  CASE WHEN event_id % 10 = 0 THEN 17 ELSE 6 END AS protocol,
  value * CAST(1000 AS DOUBLE) AS flow_duration,
  value * CAST(10 AS DOUBLE) AS flow_iat_mean,
  1 + event_id % 9 AS fwd_pkts,
  event_id % 5 AS bwd_pkts,
  value * CAST(3 AS DOUBLE) AS fwd_bytes,
  value * CAST(event_id % 4 AS DOUBLE) AS bwd_bytes,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS flag_syn,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS flag_ack,
  CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 1 ELSE 0 END AS flag_rst,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS flag_fin,
  CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS flag_psh,
  CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS flag_urg,
  CAST(32 + event_id % 97 AS DOUBLE) AS pkt_ttl_mean,
  CAST((event_id * 37) % 65536 AS DOUBLE) AS pkt_win_mean,
  value * value AS pkt_payload_var,
  CAST(event_id % 11 AS DOUBLE) / CAST(10 AS DOUBLE) AS pkt_payload_nonzero_ratio,
  CAST(event_id % 7 AS DOUBLE) - CAST(3 AS DOUBLE) AS pkt_payload_skew,
  CAST(event_id % 13 AS DOUBLE) - CAST(6 AS DOUBLE) AS pkt_payload_kurtosis,
  event_id % 3 AS retransmission_count,
  CASE WHEN event_id % 20 = 0 THEN 1 ELSE 0 END AS frag_more_flag_present,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS frag_dont_flag_present,
  CAST(event_id % 17 AS DOUBLE) / CAST(4 AS DOUBLE) AS port_scan_entropy,
  CAST(event_id % 9 AS DOUBLE) / CAST(8 AS DOUBLE) AS port_scan_sequential_ratio,
  event_id % 12 AS port_scan_max_sequential_run,
  event_id % 31 AS unique_dst_ports_per_src,
  CASE WHEN event_type <> 'error' THEN 'BENIGN'
       WHEN event_id % 4 = 0 THEN 'DoS Hulk'
       WHEN event_id % 4 = 1 THEN 'PortScan'
       WHEN event_id % 4 = 2 THEN 'SSH-Patator' ELSE 'Bot' END AS attack_family,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_attack
FROM {events}
"""

PACKETS = """
SELECT event_id AS pkt_id, {epoch} AS ts,
  CASE WHEN event_id % 3 = 0 THEN concat('10.1.0.', CAST(user_id % 5 AS VARCHAR(20))) ELSE concat('10.0.0.', CAST(user_id AS VARCHAR(20))) END AS src_ip,
  CASE WHEN event_id % 3 = 0 THEN concat('10.0.0.', CAST(user_id AS VARCHAR(20))) ELSE concat('10.1.0.', CAST(user_id % 5 AS VARCHAR(20))) END AS dst_ip,
  CASE WHEN event_id % 3 = 0 THEN 443 ELSE 40000 + user_id END AS sport,
  CASE WHEN event_id % 3 = 0 THEN 40000 + user_id ELSE 443 END AS dport,
  CASE WHEN user_id % 10 = 0 THEN 17 ELSE 6 END AS proto,
  value AS payload_len,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS syn,
  CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS fin,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS rst,
  CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS psh,
  CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS ack
FROM {events}
"""

LABELLED_REF = """
SELECT event_id AS orig_id, concat('u', CAST(user_id AS VARCHAR(20))) AS canon_key,
  CAST(floor({epoch}) AS BIGINT) + CASE WHEN event_id % 5 = 1 THEN 1 WHEN event_id % 5 = 2 THEN -2 WHEN event_id % 5 = 3 THEN 30 ELSE 0 END AS t_sec,
  event_type AS label
FROM {events} WHERE event_id % 7 <> 0
"""

UNLABELLED = """
SELECT event_id AS flow_row_id, concat('u', CAST(user_id AS VARCHAR(20))) AS canon_key,
  CAST(floor({epoch}) AS BIGINT) AS t_sec, event_type AS true_type
FROM {events}
"""

SCORES = """
SELECT event_id, CAST(event_id % 3 AS INT) AS model_id, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS day,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true,
  CAST((event_id * 7919) % 1000 AS DOUBLE) * CAST('0.0006' AS DOUBLE) + CASE WHEN event_type = 'error' THEN CAST('0.3' AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS y_prob
FROM {events}
"""

# Text table as it comes from a file: header variants, odd labels, infinities and junk.
RAW_FLOWS = """
SELECT event_id AS `row id`,
  {day_text} AS ` source_day`,
  {time_text} AS `Timestamp`,
  concat('10.0.0.', CAST(user_id % 40 AS VARCHAR(20))) AS `Src IP`,
  concat('10.1.0.', CAST(event_id % 23 AS VARCHAR(20))) AS `Dst IP`,
  CAST(1024 + event_id % 60000 AS VARCHAR(20)) AS ` Source Port`,
  CASE WHEN event_id % 29 = 0 THEN 'x' ELSE CAST(event_id % 1000 AS VARCHAR(20)) END AS `Destination Port`,
  CASE WHEN event_id % 10 = 0 THEN '17' ELSE '6' END AS `Protocol`,
  concat(CAST(event_id % 977 AS VARCHAR(20)), '.25') AS `Flow Duration`,
  concat(CAST(event_id % 83 AS VARCHAR(20)), '.5') AS `Flow IAT Mean`,
  CAST(1 + event_id % 9 AS VARCHAR(20)) AS `Tot Fwd Pkts`,
  CAST(event_id % 5 AS VARCHAR(20)) AS `Tot Bwd Pkts`,
  CAST(event_id % 400 AS VARCHAR(20)) AS `TotLen Fwd Pkts`,
  CASE WHEN event_id % 31 = 0 THEN '' ELSE CAST(event_id % 300 AS VARCHAR(20)) END AS `TotLen Bwd Pkts`,
  CASE WHEN event_id % 13 = 0 THEN 'Infinity' WHEN event_id % 17 = 0 THEN 'NaN' WHEN event_id % 19 = 0 THEN 'junk'
       ELSE concat(CAST((event_id * 7919) % 99991 AS VARCHAR(20)), '.5') END AS `Flow Bytes/s`,
  CASE WHEN event_id % 23 = 0 THEN '-Infinity' ELSE CAST((event_id * 31) % 1009 AS VARCHAR(20)) END AS `Flow Packets/s`,
  CASE WHEN event_type = 'signup' THEN CAST(event_id % 3 AS VARCHAR(20)) ELSE '0' END AS `SYN Flag Count`,
  CASE WHEN event_type = 'error' THEN '2' ELSE 'none' END AS `RST Flag Count`,
  CASE WHEN event_type <> 'error' THEN CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN '  ' ELSE 'BENIGN' END
       WHEN event_id % 8 = 0 THEN ' DoS Hulk ' WHEN event_id % 8 = 1 THEN 'Port Scan' WHEN event_id % 8 = 2 THEN 'SSH-PATATOR'
       WHEN event_id % 8 = 3 THEN 'Web Attack - XSS' WHEN event_id % 8 = 4 THEN 'Botnet ARES'
       WHEN event_id % 8 = 5 THEN 'Web Attack - Sql Injection' WHEN event_id % 8 = 6 THEN 'Web Attack - Brute Force'
       ELSE ' Novel Thing ' END AS `Label`
FROM {events}
"""

# Typed packets on a time axis 200 times as dense, so that conversations have several packets.
DENSE_PACKETS = """
SELECT pkt_id, 1704067200000000 + CAST(floor((ts - 1704067200) * 5000) AS BIGINT) AS ts_us,
  src_ip, dst_ip, CAST(sport AS INT) AS sport, CAST(dport AS INT) AS dport, proto, proto = 6 AS is_tcp, false AS is_other,
  CAST(60 + pkt_id % 900 AS DOUBLE) AS frame_len, CAST(40 + pkt_id % 25 AS DOUBLE) AS ttl,
  CAST((pkt_id * 13) % 700 AS DOUBLE) * CAST(CASE WHEN pkt_id % 3 = 1 THEN 0 ELSE 1 END AS DOUBLE) AS payload_len,
  CAST(20 + 4 * (pkt_id % 6) AS DOUBLE) AS header_len, pkt_id % 50 = 0 AS more_frag, pkt_id % 2 = 0 AS dont_frag,
  CAST(pkt_id % 7 AS DOUBLE) AS frag_offset, CAST((pkt_id * 37) % 65536 AS DOUBLE) AS tcp_window, pkt_id % 17 = 0 AS is_retx,
  CASE WHEN pkt_id % 6 = 0 THEN fin ELSE 0 END AS fin, syn, CASE WHEN pkt_id % 9 = 0 THEN rst ELSE 0 END AS rst, psh, ack,
  0 AS urg, 0 AS ece, 0 AS cwr
FROM ({packets}) p
"""

RAW_PACKETS = """
SELECT event_id AS pkt_id,
  CASE WHEN event_id % 37 = 0 THEN 'bad' ELSE {epoch_text} END AS `frame.time_epoch`,
  CAST(60 + event_id % 900 AS VARCHAR(20)) AS `frame.len`,
  CASE WHEN event_id % 41 = 0 THEN '' ELSE concat('10.0.0.', CAST(user_id AS VARCHAR(20))) END AS `ip.src`,
  concat('10.1.0.', CAST(user_id % 5 AS VARCHAR(20))) AS `ip.dst`, '6' AS `ip.proto`,
  CAST(40 + event_id % 25 AS VARCHAR(20)) AS `ip.ttl`,
  CASE WHEN event_id % 50 = 0 THEN '1' ELSE '0' END AS `ip.flags.mf`, CASE WHEN event_id % 2 = 0 THEN '1' ELSE '' END AS `ip.flags.df`,
  CAST(event_id % 7 AS VARCHAR(20)) AS `ip.frag_offset`,
  CASE WHEN event_id % 10 < 7 THEN CAST(40000 + user_id AS VARCHAR(20)) ELSE '' END AS `tcp.srcport`,
  CASE WHEN event_id % 10 < 7 THEN '443' ELSE '' END AS `tcp.dstport`,
  CASE WHEN event_id % 10 < 7 THEN CAST((event_id * 37) % 65536 AS VARCHAR(20)) ELSE '' END AS `tcp.window_size_value`,
  CASE WHEN event_id % 10 < 6 THEN CAST(event_id % 1400 AS VARCHAR(20)) ELSE '' END AS `tcp.len`,
  CASE WHEN event_id % 10 < 5 THEN '32' ELSE '' END AS `tcp.hdr_len`, CAST(event_id AS VARCHAR(20)) AS `tcp.seq`,
  CASE WHEN event_id % 10 >= 7 THEN '' WHEN event_id % 4 = 0 THEN '0x0012' WHEN event_id % 4 = 1 THEN '0x00C1'
       WHEN event_id % 4 = 2 THEN '24' ELSE 'zz' END AS `tcp.flags`,
  CASE WHEN event_id % 17 = 0 THEN '1' ELSE '' END AS `tcp.analysis.retransmission`,
  CASE WHEN event_id % 10 IN (7, 8) THEN CAST(50000 + user_id AS VARCHAR(20)) ELSE '' END AS `udp.srcport`,
  CASE WHEN event_id % 10 IN (7, 8) THEN '53' ELSE '' END AS `udp.dstport`,
  CASE WHEN event_id % 10 = 7 THEN CAST(event_id % 300 AS VARCHAR(20)) ELSE '' END AS `udp.length`
FROM {events}
"""

# The dense packets as the text table they would be read from. UDP has no flags, window or retransmissions and a fixed header there.
PACKET_TEXT = """
SELECT pkt_id, concat(CAST(ts_us {div} 1000000 AS VARCHAR(20)), '.', lpad(CAST(ts_us % 1000000 AS VARCHAR(20)), 6, '0')) AS `frame.time_epoch`,
  CAST(CAST(frame_len AS BIGINT) AS VARCHAR(20)) AS `frame.len`, src_ip AS `ip.src`, dst_ip AS `ip.dst`, CAST(proto AS VARCHAR(20)) AS `ip.proto`,
  CAST(CAST(ttl AS BIGINT) AS VARCHAR(20)) AS `ip.ttl`, CASE WHEN more_frag THEN '1' ELSE '0' END AS `ip.flags.mf`,
  CASE WHEN dont_frag THEN '1' ELSE '' END AS `ip.flags.df`, CAST(CAST(frag_offset AS BIGINT) AS VARCHAR(20)) AS `ip.frag_offset`,
  CASE WHEN is_tcp THEN CAST(sport AS VARCHAR(20)) ELSE '' END AS `tcp.srcport`, CASE WHEN is_tcp THEN CAST(dport AS VARCHAR(20)) ELSE '' END AS `tcp.dstport`,
  CASE WHEN is_tcp THEN CAST(CAST(tcp_window AS BIGINT) AS VARCHAR(20)) ELSE '' END AS `tcp.window_size_value`,
  CASE WHEN is_tcp THEN CAST(CAST(payload_len AS BIGINT) AS VARCHAR(20)) ELSE '' END AS `tcp.len`,
  CASE WHEN is_tcp THEN CAST(CAST(header_len AS BIGINT) AS VARCHAR(20)) ELSE '' END AS `tcp.hdr_len`, '' AS `tcp.seq`,
  CASE WHEN is_tcp THEN CAST(fin + 2 * syn + 4 * rst + 8 * psh + 16 * ack AS VARCHAR(20)) ELSE '' END AS `tcp.flags`,
  CASE WHEN is_tcp AND is_retx THEN '1' ELSE '' END AS `tcp.analysis.retransmission`,
  CASE WHEN is_tcp THEN '' ELSE CAST(sport AS VARCHAR(20)) END AS `udp.srcport`, CASE WHEN is_tcp THEN '' ELSE CAST(dport AS VARCHAR(20)) END AS `udp.dstport`,
  CASE WHEN is_tcp THEN '' ELSE CAST(CAST(payload_len AS BIGINT) + 8 AS VARCHAR(20)) END AS `udp.length`
FROM ({packets}) p
"""

# Flows with the text a published table identifies them by.
FLOW_TEXT = """
SELECT event_id, concat('10.0.0.', CAST(user_id % 40 AS VARCHAR(20))) AS src_ip, concat('10.1.0.', CAST(event_id % 23 AS VARCHAR(20))) AS dst_ip,
  1024 + event_id % 600 AS src_port, 80 + event_id % 3 AS dst_port, CASE WHEN event_id % 10 = 0 THEN 17 ELSE 6 END AS protocol,
  1 + event_id % 9 AS fwd_pkts, ts, event_type
FROM {events}
"""

VIEWS = {"flows": FLOWS, "packets": PACKETS, "labelled_ref": LABELLED_REF,
         "unlabelled": UNLABELLED, "scores": SCORES}


def duck(name: str) -> str:
    if name == "raw_flows":
        return RAW_FLOWS.replace("`", '"').format(
            events="events", day_text="concat(dayname(ts), '-WorkingHours.csv')",
            time_text="strftime(ts, '%d/%m/%Y %H:%M:%S')")
    if name == "dense_packets":
        return DENSE_PACKETS.format(packets=duck("packets"))
    if name == "flow_text":
        return FLOW_TEXT.format(events="events")
    if name == "raw_packets":
        return RAW_PACKETS.replace("`", '"').format(events="events", epoch_text=f"printf('%.6f', {DUCK_EPOCH})")
    return VIEWS[name].format(epoch=DUCK_EPOCH, events="events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "raw_flows":
        text = RAW_FLOWS.format(
            events="{src}", day_text="concat(date_format(ts, 'EEEE'), '-WorkingHours.csv')",
            time_text="date_format(ts, 'dd/MM/yyyy HH:mm:ss')")
        return spark.sql(text, src=table(spark, sf_dir, "events"))
    if name == "dense_packets":
        return spark.sql(DENSE_PACKETS.format(packets="SELECT * FROM {src}"), src=view(spark, sf_dir, "packets"))
    if name == "packet_text":
        return spark.sql(PACKET_TEXT.format(packets="SELECT * FROM {src}", div="div"), src=view(spark, sf_dir, "dense_packets"))
    if name == "flow_text":
        return spark.sql(FLOW_TEXT.format(events="{src}"), src=table(spark, sf_dir, "events"))
    if name == "raw_packets":
        text = RAW_PACKETS.format(events="{src}", epoch_text=f"format_string('%.6f', {SPARK_EPOCH})")
        return spark.sql(text, src=table(spark, sf_dir, "events"))
    return spark.sql(VIEWS[name].format(epoch=SPARK_EPOCH, events="{src}"), src=table(spark, sf_dir, "events"))
