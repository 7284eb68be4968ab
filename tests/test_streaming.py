"""Streaming results next to the batch results on closed windows."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.config import FEATURES, SequenceConfig, WindowConfig
from tidewatch.operators import windows as ops
from tidewatch.sources.tables import FLOW_RECORD_SCHEMA, stream_flow_records
from tidewatch.sources.contract import to_engine
from tidewatch.streaming import assembler as sa
from tidewatch.streaming import windows as sw

T0 = 1_700_000_000.0
CFG, SEQ = WindowConfig(), SequenceConfig(history=4, horizon=2)


def put(folder, n, rows):
    """One input file; files are read in the order of their modification time."""
    f = folder / f"{n:03d}.json"
    f.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(f, (1_700_000_000 + n * 10, 1_700_000_000 + n * 10))


def feed(tmp_path, session="s1", skip=(9, 10), until=300, per_window=6):
    """Flows of 10-second windows, one JSON file per half minute; two idle windows."""
    rows = []
    for w in range(until // 10):
        if w in skip:
            continue
        for i in range(per_window):
            t = T0 + w * 10 + i * 1.5
            rows.append({"session_id": session, "flow_start_epoch": t, "Source IP": f"10.0.0.{i % 3}", "Destination IP": f"10.1.0.{(i + w) % 4}",
                         "Source Port": 1000 + i, "Destination Port": [80, 443, 22][(i * w) % 3], "Protocol": 17 if i % 5 == 0 else 6,
                         "Flow Duration": 1000.0 * (i + 1), "Flow IAT Mean": 10.0 * (i + w), "Total Fwd Packets": 3 + i, "Total Backward Packets": i,
                         "Total Length of Fwd Packets": 100.0 * (i + 1), "Total Length of Bwd Packets": 50.0 * w,
                         **{f"flag_true_{f}": int(i % 2 == 0) for f in ("fin", "syn", "rst", "psh", "ack", "urg")}})
    out = tmp_path / f"in_{session}"
    out.mkdir()
    for n, part in enumerate(range(0, len(rows), 18)):
        put(out, n, rows[part:part + 18])
    return str(out), pd.DataFrame(rows)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def run(query_df, tmp_path, name):
    out, cp = str(tmp_path / name), str(tmp_path / f"{name}_cp")
    q = sw.write_stream(query_df, out, cp, available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    return out


def test_stream_windows_equal_batch(rocks, tmp_path):
    spark = rocks
    path, pdf = feed(tmp_path)
    flows = to_engine(stream_flow_records(spark, path, 2))
    out = run(sw.closed_windows(flows, CFG, T0), tmp_path, "windows")
    got = spark.read.parquet(out).orderBy("window_index").toPandas()
    batch = to_engine(spark.createDataFrame(pdf, FLOW_RECORD_SCHEMA)).withColumn("day", F.lit("d"))
    want = ops.guard_features(ops.aggregate_windows(ops.assign_windows(batch, CFG).withColumn("attack_family", F.lit("BENIGN")).withColumn("is_attack", F.lit(0)), CFG)).toPandas()
    want = want.set_index("window_index").sort_index()
    assert list(got.window_index) == sorted(got.window_index) and not got.window_index.duplicated().any()
    assert len(got) >= len(want) - 2            # the last windows stay open
    for f in sw.STREAM_FEATURES:
        expect = want.loc[got.window_index, f].to_numpy()
        assert abs(got[f].to_numpy() - expect).max() < 1e-6 * max(1.0, abs(expect).max()), f


def test_stream_anchors_fill_idle_windows_and_come_once(rocks, tmp_path):
    spark = rocks
    path, _ = feed(tmp_path)
    flows = to_engine(stream_flow_records(spark, path, 2))
    anchors = sw.stream_anchors(sw.closed_windows(flows, CFG, T0), CFG, SEQ)
    got = spark.read.parquet(run(anchors, tmp_path, "anchors")).orderBy("window_index").toPandas()
    index = list(got.window_index)
    assert index == list(range(SEQ.history - 1, index[-1] + 1)) and index[-1] >= 27
    idle = got[got.window_index == 9].iloc[0]
    assert idle.features[FEATURES.index("flow_count")] == 0.0
    assert idle.features[FEATURES.index("window_index_in_day")] == 9.0
    assert all(len(x) == SEQ.history for x in got.x)


def packet(i, t, src, dst, sp, dp, proto=6, flags="", size=60):
    return {"pkt_id": i, "ts": t, "src_ip": src, "dst_ip": dst, "sport": sp, "dport": dp, "proto": proto, "frame_len": float(size),
            **{f: int(f[0] in flags) if f not in ("psh",) else int("p" in flags) for f in sa.FLAGS}}


SCHEMA = ("pkt_id bigint, ts double, src_ip string, dst_ip string, sport int, dport int, proto int, frame_len double, "
          + ", ".join(f"{f} int" for f in sa.FLAGS))


def test_stream_flow_assembly(rocks, tmp_path):
    spark = rocks
    src = tmp_path / "pk"
    src.mkdir()
    a, b = "10.0.0.1", "10.0.0.2"
    scan = [packet(i, T0 + i * 0.01, a, b, 40000, 1000 + i, flags="s") for i in range(20)]
    talk = [packet(100 + i, T0 + 1 + i * 0.5 / 7, *((a, b, 5000, 80) if i in (0, 2, 3, 5, 7) else (b, a, 80, 5000)), flags=f)
            for i, f in enumerate(["s", "sa", "a", "pa", "pa", "pa", "pa", "fa"])]
    udp = [packet(200, T0 + 2, a, b, 53, 5353, 17)]
    late = [packet(300, T0 + 60, a, "10.9.9.9", 1, 2), packet(301, T0 + 61, a, "10.9.9.9", 1, 2)]
    end = [packet(400, T0 + 500, a, "10.8.8.8", 1, 2)]
    for n, part in enumerate([scan + talk + udp, late, end]):
        put(src, n, part)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    got = spark.read.parquet(run(sa.stream_flows(stream), tmp_path, "flows")).toPandas()
    probes = got[got.src_port == 40000]
    assert len(probes) == 20 and set(probes.bwd_pkts) == {0}
    full = got[got.src_port == 5000]
    assert [(r.fwd_pkts, r.bwd_pkts) for r in full.itertuples()] == [(5, 3)] and abs(full.iloc[0].flow_duration - 5e5) < 1
    assert len(got[got.protocol == 17]) == 1
    pair = got[got.dst_ip == "10.9.9.9"]
    assert [r.fwd_pkts for r in pair.itertuples()] == [2]


def test_stream_flow_assembly_takes_late_packets_in_time_order(rocks, tmp_path):
    """The opening packet comes a batch after its answer, within the grace."""
    spark = rocks
    src = tmp_path / "pk"
    src.mkdir()
    a, b = "10.0.0.1", "10.0.0.2"
    answer = [packet(2, T0 + 1.0, b, a, 80, 5000, flags="sa"), packet(4, T0 + 2.0, b, a, 80, 5000, flags="a")]
    opening = [packet(1, T0 + 0.5, a, b, 5000, 80, flags="s"), packet(3, T0 + 1.5, a, b, 5000, 80, flags="a")]
    end = [packet(9, T0 + 500, a, "10.8.8.8", 1, 2)]
    for n, part in enumerate([answer, opening, end, [dict(end[0], pkt_id=10, ts=T0 + 600)]]):
        put(src, n, part)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(src))
    got = spark.read.parquet(run(sa.stream_flows(stream), tmp_path, "flows")).toPandas()
    one = got[got.dst_ip != "10.8.8.8"]
    assert [(r.src_ip, r.src_port, r.fwd_pkts, r.bwd_pkts, r.fwd_iat_total, r.bwd_iat_total) for r in one.itertuples()] == [(a, 5000, 2, 2, 1e6, 1e6)]
    assert abs(one.iloc[0].flow_duration - 1.5e6) < 1 and abs(one.iloc[0].flow_start_epoch - T0 - 0.5) < 1e-6
