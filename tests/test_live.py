"""Live forecasts next to the batch ones: two sessions, idle gaps, late flows, attacks, a restart, a replayed batch and the end of the stream."""

import json
import os
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.config import BENIGN, AlertConfig, Config, SequenceConfig, WindowConfig
from tidewatch.operators.progression import progression_now
from tidewatch.streaming import live
from tidewatch.streaming import windows as sw

T0 = 1_700_000_000.0
CFG = Config(window=WindowConfig(), sequence=SequenceConfig(history=4, horizon=2), alert=AlertConfig(threshold=0.5))
FLOWS = ("session_id string, flow_start_epoch double, src_ip string, dst_ip string, dst_port int, protocol int, fwd_pkts bigint, bwd_pkts bigint, "
         "fwd_bytes double, bwd_bytes double, flag_syn bigint, is_attack int, attack_family string")
TABLE = [("NORMAL", 1, "NORMAL", 0.9), ("NORMAL", 1, "ONSET", 0.1), ("NORMAL", 2, "NORMAL", 1.0), ("ONSET", 1, "ACTIVE", 0.8), ("ONSET", 1, "NORMAL", 0.2),
         ("ONSET", 2, "ACTIVE", 0.6), ("ONSET", 2, "CONTINUATION", 0.4), ("ACTIVE", 1, "ACTIVE", 0.7), ("ACTIVE", 1, "NORMAL", 0.3), ("ACTIVE", 2, "NORMAL", 1.0)]


def put(folder, n, rows):
    f = folder / f"{n:03d}.json"
    f.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(f, (1_700_000_000 + n * 10, 1_700_000_000 + n * 10))


def flows_of(session, windows, attacks, seed):
    draw = random.Random(seed)
    rows = []
    for w in windows:
        bad = w in attacks
        for i in range(8):
            rows.append({"session_id": session, "flow_start_epoch": T0 + w * 10 + i, "src_ip": f"10.0.0.{i % 3}", "dst_ip": f"10.1.0.{draw.randrange(5)}",
                         "dst_port": draw.choice([80, 443, 22, 8080]), "protocol": 17 if i % 4 == 0 else 6, "fwd_pkts": 1 + i, "bwd_pkts": i % 3,
                         "fwd_bytes": 100.0 * (1 + i), "bwd_bytes": 10.0 * i, "flag_syn": int(i % 2 == 0), "is_attack": int(bad and i < 6),
                         "attack_family": (("Bot" if w % 5 == 0 else "PortScan") if bad and i < 6 else BENIGN)})
    return rows


def feed(folder):
    """Two sessions in files of event time; one flow comes three files late into a window that is closed by then."""
    a = flows_of("a", [w for w in range(26) if w not in (9, 10, 11)], {4, 5, 6, 7, 15, 16, 20}, 1)
    b = flows_of("b", [w for w in range(22) if w != 5], {12, 13, 14}, 2)
    rows = sorted(a + b, key=lambda r: r["flow_start_epoch"])
    parts = [rows[i:i + 60] for i in range(0, len(rows), 60)]
    late = dict(a[0], flow_start_epoch=T0 + 1.5, dst_port=9999)
    parts[4] = parts[4] + [late]
    for n, part in enumerate(parts):
        put(folder, n, part)
    return rows, late


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def finish(query):
    query.awaitTermination(300)
    assert query.exception() is None


def keyed(rows):
    return {(r["session_id"], r["window_index"]): r.asDict(True) for r in rows}


def test_live_forecasts_equal_batch_once_each_and_close_at_the_end(rocks, tmp_path):
    spark = rocks
    source, marks = tmp_path / "flows", tmp_path / "marks"
    source.mkdir(), marks.mkdir()
    rows, _ = feed(source)
    table = spark.createDataFrame(TABLE, "state string, k int, next string, prob double")
    outlook = live.outlook_table(spark, table, CFG, "PortScan")
    sink, counts = live.ForecastSink(str(tmp_path / "out"), keep=5), live.FlowCountSink(str(tmp_path / "out"))

    def stream():
        return spark.readStream.schema(FLOWS).option("maxFilesPerTrigger", 2).json(str(source))

    def run():
        joined = live.with_markers(stream(), live.stream_markers(spark, str(marks)))
        found = live.forecast_stream(joined, outlook, None, T0, CFG, "PortScan", size_step=None)
        finish(live.run_sink(found, sink, str(tmp_path / "cp"), available_now=True))
        finish(live.run_sink(stream(), counts, str(tmp_path / "cp_flows"), available_now=True))

    run()                                          # the last windows are still open after this
    before = sink.forecasts(spark).collect()
    live.mark_end(spark, str(marks), T0 + 26 * 10)
    run()                                          # a new query from the same checkpoint closes them
    got = sink.forecasts(spark).collect()
    assert len(before) < len(got) and {(r["session_id"], r["window_index"]) for r in before} <= set(keyed(got))
    assert len(keyed(got)) == len(got)             # nothing twice

    batch = spark.createDataFrame(rows, FLOWS)      # the late flow isn't in it: its window was closed
    windows = sw.closed_windows(batch, CFG.window, T0, size_step=None)
    want = live.live_forecasts(sw.batch_anchors(windows, CFG.window, CFG.sequence), outlook, None, "PortScan").collect()
    left, right = keyed(got), keyed(want)
    assert left.keys() == right.keys() and ("a", 10) in left and ("b", 21) in left and ("a", 25) in left
    for at, own in right.items():
        for name, value in own.items():
            assert left[at][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (at, name)
    assert {r["now"] for r in want} == {"NORMAL", "ONSET", "ACTIVE", "CONTINUATION"} and any(r["alert"] for r in want)

    latest = sink.latest(spark).collect()
    assert sorted((r["session_id"], r["window_index"]) for r in latest) == [("a", i) for i in range(21, 26)] + [("b", i) for i in range(17, 22)]
    totals = {r["session_id"]: r.asDict() for r in sink.counters(spark).collect()}
    for s in "ab":
        own = [r for r in want if r["session_id"] == s]
        flows = sum(r["session_id"] == s for r in rows) + (s == "a")
        assert totals[s] == {"session_id": s, "flows_in": flows, "windows": len(own), "forecasts": len(own), "alerts": sum(r["alert"] for r in own)}

    # the last micro-batch once more, as after a crash between the sink and the commit
    files = sorted(os.listdir(tmp_path / "cp" / "commits"), key=lambda n: (len(n), n))
    last = [n for n in files if n.isdigit()][-1]
    state = sorted(map(tuple, sink.counters(spark).collect()))
    again = spark.read.parquet(f"{tmp_path}/out/forecasts/batch={last}")
    rows_again = spark.createDataFrame(again.collect(), again.schema)
    sink(rows_again, int(last))
    assert len(sink.forecasts(spark).collect()) == len(got) and sorted(map(tuple, sink.counters(spark).collect())) == state
    assert {(r["session_id"], r["window_index"]) for r in sink.latest(spark).collect()} == {(r["session_id"], r["window_index"]) for r in latest}


def test_live_equals_the_serving_chain_for_unlabelled_flows(spark):
    """Flows as they come from a sensor carry no label: then the anchors are those of the upload chain."""
    from tidewatch.plans.corpus import state_windows
    from tidewatch.plans.serve import forecast_anchors

    rows = [dict(r, is_attack=0, attack_family=BENIGN) for r in flows_of("a", [w for w in range(26) if w not in (9, 10, 11)], set(), 1)]
    names = ("flow_duration", "flow_iat_mean", "pkt_ttl_mean", "pkt_win_mean", "pkt_payload_var", "pkt_payload_nonzero_ratio", "pkt_payload_skew",
             "pkt_payload_kurtosis", "retransmission_count", "frag_more_flag_present", "frag_dont_flag_present", "port_scan_entropy",
             "port_scan_sequential_ratio", "port_scan_max_sequential_run", "unique_dst_ports_per_src")
    flags = [f"flag_{f}" for f in ("ack", "rst", "fin", "psh", "urg")]
    flows = spark.createDataFrame(rows, FLOWS).withColumn("day", F.col("session_id")).withColumns({n: F.lit(0.0) for n in names}).withColumns({f: F.lit(0) for f in flags})
    table = spark.createDataFrame(TABLE, "state string, k int, next string, prob double")
    from tidewatch.config import FEATURES
    scaler = spark.createDataFrame([(i, f, 1.0, 2.0) for i, f in enumerate(FEATURES)], "i int, feature string, median double, iqr double")
    want = {r["window_index"]: r.asDict(True) for r in forecast_anchors(state_windows(flows, CFG.window), table, scaler, CFG).collect()}
    windows = sw.closed_windows(flows, CFG.window, T0, size_step=None)
    got = live.live_forecasts(sw.batch_anchors(windows, CFG.window, CFG.sequence), live.outlook_table(spark, table, CFG), scaler).collect()
    assert len(got) == len(want) > 20
    for r in got:
        own, found = want[r["window_index"]], r.asDict(True)
        for name in own.keys() & found.keys():
            assert found[name] == (pytest.approx(own[name], abs=1e-6) if isinstance(own[name], float) else own[name]), name


@pytest.mark.parametrize("radius", [0, 1])
def test_state_of_the_newest_window_step_by_step(spark, radius):
    cfg = replace(CFG.window, smooth_radius=radius)
    draw = random.Random(radius)
    rows = [("s", i, draw.choice([0, 5]), draw.choice([0.01, 0.1, 0.2, 0.9]), draw.choice([BENIGN, "Bot", "PortScan"])) for i in range(300)]
    frame = spark.createDataFrame(rows, "session_id string, window_index long, attack_flows int, attack_ratio double, dominant_family string")
    want = [r["progression_state"] for r in progression_now(frame, cfg, ["session_id"]).orderBy("window_index").collect()]
    got, state = [], None
    for _, _, flows, ratio, family in rows:
        one = sw.Progression(cfg, state)
        got.append(one.step(flows, ratio, family))
        state = json.loads(json.dumps(one.state))
    assert got == want and set(got) == {"NORMAL", "ONSET", "ACTIVE", "CONTINUATION"}


def test_running_tables_take_a_replayed_batch_once(spark, tmp_path):
    path = str(tmp_path / "n")
    batch = spark.createDataFrame([("a", 1, 0, 0, 0), ("b", 2, 0, 0, 0)], live.COUNTER_SCHEMA)
    for n in (0, 1, 1, 2, 2):
        live.fold(spark, path, n, batch, live._added)
    got = {r["session_id"]: r["flows_in"] for r in live.newest(spark, path, live.COUNTER_SCHEMA).collect()}
    assert got == {"a": 3, "b": 6} and live._versions(spark, path) == [1, 2]
    assert live.newest(spark, str(tmp_path / "none"), live.COUNTER_SCHEMA).collect() == []


def test_closed_windows_of_many_sizes_and_narrow_value_counts(spark):
    n = 12_000                                   # one window whose sizes all differ
    flows = spark.range(n).select(
        (F.col("id") / 1000).alias("flow_start_epoch"), F.lit("a").alias("src_ip"), F.concat(F.lit("b"), F.col("id") % 7).alias("dst_ip"),
        F.col("id").cast("int").alias("dst_port"), F.lit(6).alias("protocol"), (F.col("id") * 3.0).alias("fwd_bytes"), F.lit(1).alias("fwd_pkts"))
    rows = sw.closed_windows(flows, WindowConfig(window_seconds=60.0, stride_seconds=60.0), 0.0, size_step=None)
    (got,) = rows.select("flow_count", "packet_count", "fan_out", "unique_dst_ports", "flowsize_entropy").collect()
    sizes = np.log1p(np.arange(n) * 3.0)
    share = np.histogram(sizes, 16)[0] / n
    share = share[share > 0]
    assert got[:4] == (n, n, 7, n) and abs(got[4] + (share * np.log2(share)).sum()) < 1e-9
    # the rows per value don't carry the sums of the flows
    lines = rows._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in lines if "Aggregate" in x and "v2#" in x and "s_fwd_pkts" in x]
