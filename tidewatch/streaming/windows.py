"""Live path: flow records -> closed windows -> anchors with L windows of history.

Stage 1 is a chain of native event-time aggregations. Stage 2 keeps, per session,
only the last windows in state. Windows are aligned to a start time the caller
gives, because a stream cannot know its earliest event.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.config import BENIGN, DELTA_FEATURES, FEATURES, SequenceConfig, WindowConfig
from tidewatch.operators.progression import progression_now
from tidewatch.operators.sequences import serving_sequences
from tidewatch.operators.windows import fill_idle, time_features

GRACE_SECONDS = 3
SESSION_TTL_SECONDS = 900
MARKER = "is_marker"
SIZE_STEP = 256          # sizes are rounded to 1/256 of a log unit before the histogram, so at most ~10,000 remain
SUMS = ("fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "flag_syn", "flag_ack", "flag_rst", "flag_fin", "flag_psh",
        "flag_urg", "retransmission_count", "is_attack")
SQUARES = ("flow_iat_mean", "pkt_ttl_mean", "pkt_win_mean")
MEANS = ("flow_duration", "pkt_payload_var", "pkt_payload_nonzero_ratio", "pkt_payload_skew", "pkt_payload_kurtosis",
         "frag_more_flag_present", "frag_dont_flag_present", "port_scan_entropy")
TOPS = ("port_scan_sequential_ratio", "port_scan_max_sequential_run", "unique_dst_ports_per_src")


def _entropy(kind: str) -> Column:
    c = F.when(F.col("kind") == kind, F.col("n").cast("double"))
    return F.coalesce(F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c), F.lit(0.0))


def closed_windows(flows: DataFrame, cfg: WindowConfig = WindowConfig(), start_epoch: float = 0.0,
                   grace_seconds: float = GRACE_SECONDS, size_step: int | None = SIZE_STEP) -> DataFrame:
    """One row per (session, window) once the watermark has passed its end; works on a batch table too.

    The volume sums are one event-time aggregate of the flows. Beside it three narrow levels turn counts of pairs, ports, sizes and
    families into distinct counts, fan-out and entropies without holding a window's flows; the last level takes both. ``size_step``
    rounds the log sizes behind ``flowsize_entropy`` to its inverse, which bounds the state of a live window; None counts them exactly,
    as the batch features do.
    """
    w = float(cfg.window_seconds)
    have = set(flows.columns)

    def num(name):
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)

    offset = start_epoch % w
    rows = flows.withColumn("event_time", F.timestamp_micros((F.col("flow_start_epoch") * 1000000).cast("bigint")))
    if flows.isStreaming:
        rows = rows.withWatermark("event_time", f"{grace_seconds} seconds")
    size = F.log1p(num("fwd_bytes") + num("bwd_bytes"))
    size = size if size_step is None else F.round(size * size_step) / size_step

    def kind(name, v1=None, v2=None, v=None):
        text = [(F.lit(None) if c is None else F.col(c)).cast("string").alias(a) for a, c in (("v1", v1), ("v2", v2))]
        return F.struct(F.lit(name).alias("kind"), *text, (F.lit(None) if v is None else v).cast("double").alias("v"))

    kinds = [kind("pair", "src_ip", "dst_ip"), kind("port", "dst_port"), kind("size", v=size)]
    if "attack_family" in have:
        kinds.append(F.when(num("is_attack") == 1, kind("fam", "attack_family")))
    kinds = F.array_compact(F.array(*kinds))
    session = F.coalesce(F.col("session_id"), F.lit("default")) if "session_id" in have else F.lit("default")
    used = dict.fromkeys(SUMS + SQUARES + MEANS + TOPS)
    volume = ["event_time", "protocol", *[num(c).alias(c) for c in used]]
    if MARKER in have:
        # a marker only moves the watermark. The event time is named here so that no filter on it is moved below the watermark
        real = ~F.col(MARKER) & F.col("event_time").isNotNull()
        kinds = F.filter(kinds, lambda x: real)
        volume.append(F.explode(F.filter(F.array(F.lit(1)), lambda x: real)).alias("_real"))
    whole = rows.select(session.alias("session_id"), *volume)
    values = rows.select(session.alias("session_id"), "event_time", F.explode(kinds).alias("x")).select("session_id", "event_time", "x.*")

    span = F.window("event_time", f"{round(w * 1e6)} microseconds", startTime=f"{round(offset * 1e6)} microseconds")
    carried = [F.sum(c).alias(f"s_{c}") for c in dict.fromkeys(SUMS + SQUARES + MEANS)]
    carried += [F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in SQUARES]
    carried += [F.max(c).alias(f"t_{c}") for c in TOPS]
    carried += [F.sum((F.col(c) > 0).cast("double")).alias(f"p_{c}") for c in ("flag_rst", "flag_syn")]
    carried += [F.sum((F.col("protocol") == p).cast("double")).alias(f"p_{p}") for p in (6, 17)]
    sums = whole.groupBy(span, "session_id").agg(F.count(F.lit(1)).alias("n"), *carried).withColumn("kind", F.lit("flow"))
    names = [c for c in sums.columns if c[:2] in ("s_", "q_", "t_", "p_")]

    def again(c):
        return (F.max(c) if c.startswith("t_") else F.sum(c)).alias(c)

    one = values.groupBy(span, "session_id", "kind", "v1", "v2", "v").agg(F.count(F.lit(1)).alias("n"))
    ends = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("v1")) for k, c in (("src", "v1"), ("dst", "v2"))])
    own = F.array(F.struct("kind", "v1"))
    one = one.select("window", "session_id", "v", "n", F.explode(F.when(F.col("kind") == "pair", ends).otherwise(own)).alias("x"))
    two = one.select("window", "session_id", "x.*", "v", "n").groupBy("window", "session_id", "kind", "v1", "v").agg(
        F.count(F.lit(1)).alias("peers"), F.sum("n").alias("n"))
    two = two.unionByName(sums, allowMissingColumns=True)

    def when(k, value):
        return F.when(F.col("kind") == k, value)

    three = two.groupBy("window", "session_id").agg(
        F.sum(when("flow", F.col("n"))).alias("n"),
        F.count(when("src", F.lit(1))).alias("unique_src"), F.count(when("dst", F.lit(1))).alias("unique_dst"),
        F.sum(when("src", F.col("peers"))).alias("unique_pairs"), F.count(when("port", F.lit(1))).alias("unique_dst_ports"),
        F.max(when("src", F.col("peers"))).alias("fan_out"), F.max(when("dst", F.col("peers"))).alias("fan_in"),
        _entropy("port").alias("dstport_entropy"), _entropy("dst").alias("dstip_entropy"), _entropy("src").alias("srcip_entropy"),
        F.collect_list(when("size", F.struct("v", F.col("n").cast("double").alias("n")))).alias("sizes"),
        F.min(when("size", F.col("v"))).alias("size_lo"), F.max(when("size", F.col("v"))).alias("size_hi"),
        F.min_by(when("fam", F.col("v1")), when("fam", F.struct((-F.col("n")).alias("c"), F.col("v1").alias("f")))).alias("family"),
        *[again(c) for c in names])
    return _finish(three, w, start_epoch)


def _size_entropy() -> Column:
    """Each size is put in its slot once: the limits are columns, since an array's minimum in a lambda is searched for every element."""
    lo, hi = F.col("size_lo"), F.col("size_hi")
    width = F.when(hi > lo, hi - lo)
    slot = lambda s: F.coalesce(F.least(F.floor((s["v"] - lo) / width * 16), F.lit(15)), F.lit(0))
    slots = F.transform("sizes", lambda s: F.struct(slot(s).alias("b"), s["n"].alias("n")))

    def total(found, b=None):
        return F.aggregate(found, F.lit(0.0), lambda a, s: a + (s["n"] if b is None else F.when(s["b"] == b, s["n"]).otherwise(0.0)))

    def entropy(found):
        counts = F.transform(F.array(F.struct(total(found).alias("t"), F.array(*[total(found, b) for b in range(16)]).alias("c"))), lambda x: F.aggregate(
            x["c"], F.lit(0.0), lambda a, c: a - F.when(c > 0, c / x["t"] * F.log2(c / x["t"])).otherwise(0.0)))
        return F.get(counts, F.lit(0))

    return F.get(F.transform(F.array(slots), entropy), F.lit(0))


def _finish(rows: DataFrame, w: float, start_epoch: float) -> DataFrame:
    n = F.col("n").cast("double")
    s = lambda c: F.col(f"s_{c}")

    def var(c):
        return F.when(n > 1, F.greatest((F.col(f"q_{c}") - s(c) * s(c) / n) / F.when(n > 1, n - 1), F.lit(0.0))).otherwise(0.0)

    packets, octets = s("fwd_pkts") + s("bwd_pkts"), s("fwd_bytes") + s("bwd_bytes")
    begin = F.unix_micros(F.col("window.start")) / 1e6
    mean = lambda c: s(c) / n
    return rows.select(
        "session_id", F.col("window.end").alias("window_end"),
        F.round((begin - F.lit(float(start_epoch))) / w).cast("bigint").alias("window_index"), begin.alias("window_start"),
        n.alias("flow_count"), packets.alias("packet_count"), octets.alias("byte_count"), (packets / w).alias("packet_rate"),
        (octets / w).alias("byte_rate"), (s("fwd_pkts") / (s("bwd_pkts") + 1.0)).alias("fwd_bwd_ratio"),
        *[F.col(c).cast("double").alias(c) for c in ("unique_src", "unique_dst", "unique_pairs", "unique_dst_ports", "fan_out", "fan_in")],
        (F.col("p_flag_rst") / n).alias("failed_conn_ratio"),
        *[(s(f"flag_{f}") / w).alias(f"{f}_rate") for f in ("syn", "ack", "rst", "fin", "psh", "urg")],
        (mean("flow_duration") / 1e6).alias("flow_duration_mean"), mean("flow_iat_mean").alias("iat_mean"),
        F.sqrt(var("flow_iat_mean")).alias("iat_std"), (F.sqrt(var("flow_iat_mean")) / (mean("flow_iat_mean") + 1e-6)).alias("burstiness"),
        mean("pkt_ttl_mean").alias("ttl_mean"), var("pkt_ttl_mean").alias("ttl_var"),
        mean("pkt_win_mean").alias("tcp_window_mean"), F.sqrt(var("pkt_win_mean")).alias("tcp_window_std"),
        mean("pkt_payload_var").alias("payload_var_mean"), mean("pkt_payload_nonzero_ratio").alias("payload_nonzero_ratio"),
        mean("pkt_payload_skew").alias("payload_skew_mean"), mean("pkt_payload_kurtosis").alias("payload_kurt_mean"),
        (s("retransmission_count") / w).alias("retransmission_rate"),
        (mean("frag_more_flag_present") + mean("frag_dont_flag_present")).alias("frag_present_ratio"),
        mean("port_scan_entropy").alias("port_scan_entropy"),
        *[F.coalesce(F.col(f"t_{c}"), F.lit(0.0)).alias(a) for c, a in zip(TOPS, ("port_scan_seq_ratio", "port_scan_max_run", "unique_dst_ports_per_src"))],
        (F.col("p_6") / n).alias("tcp_ratio"), (F.col("p_17") / n).alias("udp_ratio"),
        "dstport_entropy", "dstip_entropy", "srcip_entropy", _size_entropy().alias("flowsize_entropy"),
        (F.col("p_flag_syn") / n).alias("syn_ratio"), s("is_attack").alias("attack_flows"), (s("is_attack") / n).alias("attack_ratio"),
        F.coalesce("family", F.lit(BENIGN)).alias("dominant_family"))


STREAM_FEATURES = tuple(f for f in FEATURES if not f.startswith("d_") and f not in ("time_since_prev_window", "window_index_in_day"))
ANCHOR_SCHEMA = ("session_id string, window_index bigint, window_start double, syn_ratio double, progression_state string, "
                 "features array<double>, x array<array<double>>, dt array<double>")


class Progression:
    """State of the newest window from the windows before it, one step a window: ``progression_now`` in a stream."""

    def __init__(self, cfg: WindowConfig, state: dict | None = None):
        if cfg.smooth_radius not in (0, 1):
            raise ValueError("states of the newest window need a vote of radius 0 or 1")
        # the windows whose votes may still change or are needed, and length, peak and last family of the run before them
        self.cfg, self.state = cfg, state or {"last": [], "run": [0, 0.0, BENIGN]}

    def step(self, flows: float, ratio: float, family: str) -> str:
        raw = int(flows >= self.cfg.min_attack_flows and ratio >= self.cfg.min_attack_ratio)
        last, run, r = self.state["last"], self.state["run"], self.cfg.smooth_radius
        if last:                                  # the vote on the window before is complete now
            votes = [w[0] for w in last][-1 - r:] + [raw] * r
            if 2 * sum(votes) >= len(votes):
                _, its_ratio, its_family = last[-1]
                run = [run[0] + 1, max(run[1], its_ratio), its_family if its_family != BENIGN else run[2]]
            else:
                run = [0, 0.0, BENIGN]
        votes = ([w[0] for w in last][-r:] if r else []) + [raw]
        self.state = {"last": [*last, [raw, ratio, family]][-2:], "run": run}
        if 2 * sum(votes) < len(votes):
            return "NORMAL"
        if not run[0]:
            return "ONSET"
        changed = family not in (BENIGN, run[2])
        return "CONTINUATION" if ratio < 0.5 * max(run[1], ratio) or changed else "ACTIVE"


class AnchorProcessor(StatefulProcessor):
    """Per session: fill short idle gaps, add time features and emit an anchor for each window with a full history."""

    def __init__(self, cfg: WindowConfig, seq: SequenceConfig, ttl_seconds: int = SESSION_TTL_SECONDS):
        self.cfg, self.seq, self.ttl = cfg, seq, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # state: index, start and ordinal of the last window, its features, its progression, and the last rows of history
        self.last = handle.getValueState("last", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        w, gap = float(self.cfg.window_seconds), self.cfg.max_idle_gap
        got = self.last.get() if self.last.exists() else None
        state = json.loads(got[0]) if got else {"index": None, "start": 0.0, "ordinal": -1, "history": [], "progression": None}
        out = []
        batch = pd.concat(list(rows)).sort_values("window_index")
        for r in batch.to_dict("records"):
            index = int(r["window_index"])
            if state["index"] is not None:
                if index <= state["index"]:
                    continue
                missing = index - state["index"] - 1
                if 0 < missing <= gap:
                    for i in range(state["index"] + 1, index):
                        start = float(r["window_start"]) - (index - i) * w
                        idle = {f: 0.0 for f in ("syn_ratio", "attack_flows", "attack_ratio", *STREAM_FEATURES)}
                        out += self._step(key[0], i, start, idle | {"dominant_family": BENIGN}, state)
            out += self._step(key[0], index, float(r["window_start"]), r, state)
        self.last.update((json.dumps(state),))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(int((state["start"] + w + self.ttl) * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ANCHOR_SCHEMA.split(", ")])

    def _step(self, session, index, start, values, state):
        import math
        named = {f: float(values[f]) for f in STREAM_FEATURES}
        first = state["index"] is None
        before = state.get("named") or {}
        since = float(self.cfg.window_seconds) if first else start - state["start"]
        state["ordinal"] += 1
        named["time_since_prev_window"] = since
        named["window_index_in_day"] = float(state["ordinal"])
        for f in DELTA_FEATURES:
            named[f"d_{f}"] = 0.0 if first else named[f] - before[f]
        row = [float(named[f]) for f in FEATURES]
        progression = Progression(self.cfg, state["progression"])
        now = progression.step(float(values["attack_flows"] or 0.0), float(values["attack_ratio"] or 0.0), values["dominant_family"] or BENIGN)
        if not first and index - state["index"] != 1:
            state["history"] = []
        state["history"] = (state["history"] + [[row, math.log1p(max(since, 0.0))]])[-self.seq.history:]
        state.update(index=index, start=start, named={f: named[f] for f in DELTA_FEATURES}, progression=progression.state)
        if len(state["history"]) < self.seq.history:
            return []
        return [(session, index, start, float(values["syn_ratio"]), now, row, [h[0] for h in state["history"]], [h[1] for h in state["history"]])]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_anchors(windows: DataFrame, cfg: WindowConfig = WindowConfig(), seq: SequenceConfig = SequenceConfig()) -> DataFrame:
    """Closed windows (stream) -> anchors in window order, each once per session.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    return windows.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=AnchorProcessor(cfg, seq), outputStructType=ANCHOR_SCHEMA, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="")


def batch_anchors(windows: DataFrame, cfg: WindowConfig = WindowConfig(), seq: SequenceConfig = SequenceConfig()) -> DataFrame:
    """The rows of ``stream_anchors`` for a finished table of closed windows, by window functions."""
    keys = ["session_id"]
    rows = fill_idle(windows.drop("window_end"), cfg, keys)
    rows = time_features(progression_now(rows, cfg, keys), cfg, keys)
    full = serving_sequences(rows, seq, FEATURES, keys)
    own = rows.select(*keys, "window_index", "syn_ratio", "progression_state", F.array(*[F.col(f).cast("double") for f in FEATURES]).alias("features"))
    return full.join(own, [*keys, "window_index"]).select(*[c.split()[0] for c in ANCHOR_SCHEMA.split(", ")])


def anchor_columns(anchors: DataFrame) -> DataFrame:
    """Feature array -> named columns, so that the rule set applies to the stream as it does to a batch."""
    return anchors.select("*", *[F.element_at("features", i + 1).alias(f) for i, f in enumerate(FEATURES) if f != "syn_ratio"])


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Append to Parquet; each window or anchor is written exactly once."""
    writer = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
