"""Chains that start from text files: packets to flows, published labels to matches and the labelled export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.operators import assembler
from tidewatch.plans import capture
from tidewatch.plans.catalog import network
from tidewatch.plans.catalog.cleaning import transfer_sql
from tidewatch.plans.catalog.common import big, bigs, tidy
from tidewatch.session import durable, shared_folder
from tidewatch.sources.adapters import duck, view
from tidewatch.sources.tables import PACKET_FIELDS, read_label_csv, read_packet_csv


def as_csv(rows, order: str) -> str:
    """Text files of ``rows`` in the order of ``order`` over files and lines, without that column."""
    path = f"{shared_folder(rows.sparkSession).rstrip('/')}/text/{uuid.uuid4().hex}"
    rows.repartitionByRange(order).sortWithinPartitions(order).drop(order).write.option("header", True).option("emptyValue", "").csv(path)
    return path


def packet_flows(spark, sf):
    """Dense packets written as text, read back, numbered by line, cleaned and assembled."""
    fields = [f"`{f}`" for f in PACKET_FIELDS]
    raw = read_packet_csv(spark, [as_csv(view(spark, sf, "packet_text").select("pkt_id", *fields), "pkt_id")])
    return network.flow_rows(capture.flows_of_packets(raw, assembler.CLASSIC))


UDP = {"header_len": "8", "tcp_window": "-1", "is_retx": "false", **dict.fromkeys(("fin", "syn", "rst", "psh", "ack"), "0")}
PACKET_FLOWS = network.full_sql(assembler.CLASSIC, f"SELECT * REPLACE ({', '.join(f'CASE WHEN is_tcp THEN {c} ELSE {v} END AS {c}' for c, v in UDP.items())}) "
                                                   f"FROM ({duck('dense_packets')})")


def sides(spark, sf):
    """Flows, and a published table of six of seven of them in text: some with other counts, seconds or directions."""
    rows = view(spark, sf, "flow_text")
    e = F.col("event_id")
    ident = lambda a, b: F.concat_ws("-", F.col(f"{a}_ip"), F.col(f"{b}_ip"), F.col(f"{a}_port"), F.col(f"{b}_port"), F.col("protocol"))
    text = lambda shift: F.date_format(F.timestamp_add("SECOND", shift, F.col("ts")), "dd/MM/yyyy hh:mm:ss")
    flows = rows.select(e.alias("start_pid"), ident("src", "dst").alias("flow_id"), "src_ip", "src_port", "dst_ip", "dst_port", "protocol",
                        text(F.lit(0)).alias("Timestamp"), "fwd_pkts", F.col("event_type").alias("kind"))
    turned = e % 5 == 3

    def end(a, b):
        return F.when(turned, F.col(b)).otherwise(F.col(a))

    labelled = rows.where(e % 7 != 0).select(
        "event_id", F.when(turned, ident("dst", "src")).otherwise(ident("src", "dst")).alias("Flow ID"), end("src_ip", "dst_ip").alias(" Source IP"),
        end("src_port", "dst_port").alias(" Source Port"), end("dst_ip", "src_ip").alias(" Destination IP"), end("dst_port", "src_port").alias(" Destination Port"),
        F.col("protocol").alias(" Protocol"),
        text(F.when(e % 5 == 2, -1).when(e % 5 == 4, 30).otherwise(0)).alias(" Timestamp"),
        (F.col("fwd_pkts") + (e % 5 == 1).cast("int")).alias(" Total Fwd Packets"), F.concat(F.lit(" "), F.col("event_type")).alias(" Label"))
    return durable(flows), read_label_csv(spark, [as_csv(labelled, "event_id")])


def matches(spark, sf):
    return tidy(capture.match_labels(*sides(spark, sf)))


def export(spark, sf):
    return tidy(capture.labelled_export(*sides(spark, sf)).groupBy("kind", "Label").agg(F.count(F.lit(1)).alias("flows"), F.sum("fwd_pkts").alias("packets")))


_KEY = """least(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || '<->' || greatest(src_ip || ':' || src_port, dst_ip || ':' || dst_port) || ':' || protocol AS canon_key"""
_TIME = """strftime(t, '%d/%m/%Y %I:%M:%S') AS ts_str, CAST(epoch(date_trunc('day', t)) AS BIGINT) + (hour(t) % 12) * 3600 + minute(t) * 60 + CAST(floor(second(t)) AS BIGINT) AS t_sec"""
_ID = "concat_ws('-', src_ip, dst_ip, src_port, dst_port, protocol) AS flow_id"
_FLIP = ", ".join(f"CASE WHEN event_id % 5 = 3 THEN {b} ELSE {a} END AS {a}" for a, b in (
    ("src_ip", "dst_ip"), ("src_port", "dst_port"), ("dst_ip", "src_ip"), ("dst_port", "src_port")))
TEXT = transfer_sql(
    f"SELECT event_id AS flow_row_id, {_KEY}, {_ID}, {_TIME}, src_ip, dst_ip, fwd_pkts, event_type FROM (SELECT *, ts AS t FROM ({duck('flow_text')}))",
    f"""SELECT row_number() OVER (ORDER BY event_id) - 1 AS orig_id, {_KEY}, {_ID}, {_TIME}, src_ip, dst_ip, fwd_pkts, event_type AS label FROM (
  SELECT event_id, protocol, event_type, fwd_pkts + CASE WHEN event_id % 5 = 1 THEN 1 ELSE 0 END AS fwd_pkts, {_FLIP},
    ts + CASE WHEN event_id % 5 = 2 THEN INTERVAL (-1) SECOND WHEN event_id % 5 = 4 THEN INTERVAL 30 SECOND ELSE INTERVAL 0 SECOND END AS t
  FROM ({duck('flow_text')}) WHERE event_id % 7 <> 0)""",
    ["flow_id", "src_ip", "dst_ip", "ts_str", "fwd_pkts"], ["canon_key", "ts_str"])

ENTRIES = {
    "flows_from_packet_text": (packet_flows, PACKET_FLOWS),
    "label_text_matches": (matches, f"WITH {TEXT} SELECT {big('flow_row_id', 'start_pid')}, {big('orig_id', 'label_row_id')}, label, {bigs('stage')} FROM mm"),
    "label_text_export": (export, f"""WITH {TEXT} SELECT event_type AS kind, coalesce(label, 'BENIGN') AS "Label", {big('count(*)', 'flows')}, {big('sum(fwd_pkts)', 'packets')}
 FROM l0 LEFT JOIN mm USING (flow_row_id) GROUP BY 1, 2"""),
}
