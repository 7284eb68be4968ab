"""Packets -> bidirectional flows on a stream: idle 15 s, active 120 s, closed by FIN or RST."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.packets import packet_key

IDLE_SECONDS, ACTIVE_SECONDS, HARVEST_SECONDS = 15.0, 120.0, 1.0
FLAGS = ("fin", "syn", "rst", "psh", "ack", "urg")
FLOW_SCHEMA = ("flow_start_epoch double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
               "flow_duration double, flow_iat_mean double, fwd_pkts bigint, bwd_pkts bigint, fwd_bytes double, bwd_bytes double, "
               "fwd_iat_total double, bwd_iat_total double, pkt_len_mean double, "
               + ", ".join(f"flag_{f} int" for f in FLAGS) + ", flow_end timestamp")
COLUMNS = [c.split()[0] for c in FLOW_SCHEMA.split(", ")]


PACKET_STATE = ("ts double, pkt_id bigint, src_ip string, dst_ip string, sport int, dport int, proto int, frame_len double, "
                + ", ".join(f"{f} int" for f in FLAGS))
PACKET_COLUMNS = [c.split()[0] for c in PACKET_STATE.split(", ")]


class FlowProcessor(StatefulProcessor):
    """One open flow per 5-tuple. A flow ends when its idle, active or closing time is over in event time.

    Packets wait until the watermark has passed them and are then taken in time order, so a packet that comes late
    but within the grace changes nothing. What waits is at most the packets of the grace period.
    """

    def __init__(self, idle: float = IDLE_SECONDS, active: float = ACTIVE_SECONDS, harvest: float = HARVEST_SECONDS):
        self.idle, self.active, self.harvest = idle, active, harvest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", "state string")
        self.waiting = handle.getListState("waiting", PACKET_STATE)

    def _ends(self, f: dict) -> float:
        end = min(f["t1"] + self.idle, f["t0"] + self.active)
        return min(end, f["closed"] + self.harvest) if f["closed"] is not None else end

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[PACKET_COLUMNS]
        yield self._advance([tuple(r) for r in new.astype(object).itertuples(index=False)], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance([], timerValues)

    def _advance(self, new: list[tuple], timerValues) -> pd.DataFrame:
        """Fold all packets up to the watermark; the rest waits. A timer is set for the next packet or the flow's end."""
        passed = timerValues.getCurrentWatermarkInMs() / 1000.0
        packets = sorted([*map(tuple, self.waiting.get() if self.waiting.exists() else []), *new], key=lambda r: (r[0], r[1]))
        f = json.loads(self.flow.get()[0]) if self.flow.exists() else None
        done, ready = [], [r for r in packets if r[0] <= passed]
        for r in ready:
            p = dict(zip(PACKET_COLUMNS, r))
            if f is not None and p["ts"] > self._ends(f):
                done.append(self._row(f))
                f = None
            f = self._take(f, p)
        if f is not None and self._ends(f) < passed:
            done.append(self._row(f))
            f = None
        left = packets[len(ready):]
        self.flow.clear() if f is None else self.flow.update((json.dumps(f),))
        self.waiting.put(left) if left else self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        times = [r[0] for r in left[:1]] + ([self._ends(f)] if f is not None else [])
        if times:
            self.handle.registerTimer(int(min(times) * 1000) + 1)
        return pd.DataFrame(done, columns=COLUMNS)

    def _take(self, f: dict | None, p: dict) -> dict:
        """The open flow, or a new one, with one more packet."""
        if f is None:
            f = {"src": p["src_ip"], "dst": p["dst_ip"], "sp": int(p["sport"]), "dp": int(p["dport"]), "proto": int(p["proto"]),
                 "t0": p["ts"], "t1": p["ts"], "n": [0, 0], "octets": [0.0, 0.0], "gaps": [0.0, 0.0], "seen": [None, None],
                 "flags": [0] * len(FLAGS), "closed": None}
        lane = 0 if (p["src_ip"], int(p["sport"])) == (f["src"], f["sp"]) else 1
        f["t1"] = p["ts"]
        f["n"][lane] += 1
        f["octets"][lane] += float(p["frame_len"])
        if f["seen"][lane] is not None:
            f["gaps"][lane] += p["ts"] - f["seen"][lane]
        f["seen"][lane] = p["ts"]
        if f["proto"] == 6:
            f["flags"] = [int(a or bool(p[n])) for a, n in zip(f["flags"], FLAGS)]
            if f["closed"] is None and (p["fin"] or p["rst"]):
                f["closed"] = p["ts"]
        return f

    def _row(self, f: dict) -> tuple:
        n, span = sum(f["n"]), max(0.0, (f["t1"] - f["t0"]) * 1e6)
        return (round(f["t0"], 6), f["src"], f["dst"], f["sp"], f["dp"], f["proto"], round(span, 1), round(span / max(1, n - 1), 3),
                f["n"][0], f["n"][1], f["octets"][0], f["octets"][1], round(f["gaps"][0] * 1e6, 1), round(f["gaps"][1] * 1e6, 1),
                round(sum(f["octets"]) / n, 2), *f["flags"], pd.Timestamp(int(f["t1"] * 1e6), unit="us"))

    def close(self) -> None:
        pass


def stream_flows(packets: DataFrame, grace_seconds: float = 3.0, idle: float = IDLE_SECONDS, active: float = ACTIVE_SECONDS) -> DataFrame:
    """Streaming packets (``ts, pkt_id, src_ip, ... frame_len, flags``) -> finished flows in append mode."""
    rows = packets.withColumns({
        "event_time": F.timestamp_micros((F.col("ts") * 1000000).cast("bigint")), "key": packet_key()})
    rows = rows.withWatermark("event_time", f"{grace_seconds} seconds")
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=FlowProcessor(idle, active), outputStructType=FLOW_SCHEMA, outputMode="Append", timeMode="EventTime")
