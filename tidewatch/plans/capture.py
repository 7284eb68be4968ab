"""Capture chain: packet text -> packets -> flows with scan features -> labels of a published table -> labelled export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import assembler, labels, packets
from tidewatch.session import durable, stored

TOLERANCE_SECONDS = 2
EXACT = ["flow_id", "src_ip", "dst_ip", "ts_str", "fwd_pkts"]
LOOSE = ["canon_key", "ts_str"]


def flows_of_packets(raw: DataFrame, profile: assembler.Profile = assembler.CLASSIC, order: str = "pkt_id", **options) -> DataFrame:
    """All-text packets with a packet id -> flows with the scan statistics of their source and start."""
    typed = durable(packets.clean_packets(raw, keep=(order,)))      # read by the assembler and by the scan statistics
    flows = assembler.assemble(typed, profile, order=order, **options)
    return packets.enrich_with_scans(flows, packets.scan_statistics(typed, [order]))


def match_labels(flows: DataFrame, labelled: DataFrame, left_id: str = "start_pid", right_id: str = "label_row_id") -> DataFrame:
    """``left_id``, ``right_id``, ``label`` and the stage that found the pair, for assembled flows and a table of ``read_label_csv``."""
    left = labels.match_side(flows, [left_id], "flow_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "Timestamp", "fwd_pkts")
    right = labels.match_side(labelled, [right_id, F.col("Label").alias("label")], "Flow ID", "Source IP", "Source Port", "Destination IP",
                              "Destination Port", "Protocol", "Timestamp", "Total Fwd Packets")
    return labels.transfer_labels(stored(left, "match-flows"), stored(right, "match-labels"), EXACT, LOOSE, "canon_key", "t_sec", TOLERANCE_SECONDS, left_id, right_id)


def labelled_export(flows: DataFrame, labelled: DataFrame, left_id: str = "start_pid") -> DataFrame:
    """Flows with the label of their counterpart, benign without one, and no helper columns."""
    named = labels.attach_labels(flows, match_labels(flows, labelled, left_id), left_id)
    return labels.without_helpers(named, (*labels.HELPERS, "key", left_id)).withColumnRenamed("label", "Label")
