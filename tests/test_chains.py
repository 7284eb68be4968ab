"""Chains from text to tables, row numbers, range parts under skew, and plans that leave the flows where they are."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import grouped
from tidewatch.operators import evaluate, explain, forecast, graph, labels
from tidewatch.operators import windows as ops
from tidewatch.plans import capture, serve
from tidewatch.sources import contract
from tidewatch.sources.tables import PACKET_FIELDS, read_label_csv, read_packet_csv


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "100", "spark.sql.files.minPartitionNum": "16"}
    old = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_rows_are_numbered_by_file_and_line(small_splits, tmp_path):
    spark = small_splits
    line = 0
    for name, n in (("a", 700), ("b", 1), ("c", 0), ("d", 400)):
        with open(tmp_path / f"{name}.csv", "w") as f:
            f.write(" Label ,Flow ID\n")
            for _ in range(n):
                f.write(f" L{line} ,f{line}\n")
                line += 1
    rows = read_label_csv(spark, [str(tmp_path / f"{n}.csv") for n in "dbca"])
    assert rows.rdd.getNumPartitions() > 3 and rows.columns[:2] == ["Label", "Flow ID"]
    assert sorted((r["label_row_id"], r["Label"], r["Flow ID"]) for r in rows.collect()) == [(i, f"L{i}", f"f{i}") for i in range(line)]


def test_packet_text_to_labelled_flows(spark, tmp_path):
    """Two conversations; the published table has one under the other direction's name and one second early."""
    def packet(t, src, dst, sp, dp, flags, size):
        cells = dict.fromkeys(PACKET_FIELDS, "")
        cells |= {"frame.time_epoch": f"{1_499_000_000 + t:.6f}", "frame.len": "60", "ip.src": src, "ip.dst": dst, "ip.proto": "6", "ip.ttl": "64",
                  "tcp.srcport": str(sp), "tcp.dstport": str(dp), "tcp.len": str(size), "tcp.hdr_len": "20", "tcp.flags": flags, "tcp.window_size_value": "1000"}
        return ",".join(cells[f] for f in PACKET_FIELDS)

    a, b = "192.168.10.5", "10.0.0.9"
    lines = [packet(0.0, a, b, 5000, 80, "2", 0), packet(0.1, b, a, 80, 5000, "18", 0), packet(0.2, a, b, 5000, 80, "16", 100),
             packet(5.0, a, b, 5001, 22, "2", 0), packet(5.5, b, a, 22, 5001, "18", 40), packet(6.0, a, b, 5002, 23, "2", 0), packet(6.1, b, a, 23, 5002, "18", 7),
             ",".join([""] * len(PACKET_FIELDS))]
    (tmp_path / "p.csv").write_text("\n".join([",".join(PACKET_FIELDS), *lines]) + "\n")
    flows = capture.flows_of_packets(read_packet_csv(spark, [str(tmp_path / "p.csv")]))
    got = {r["src_port"]: r for r in flows.collect()}
    assert {p: (r["fwd_pkts"], r["bwd_pkts"], r["start_pid"]) for p, r in got.items()} == {5000: (2, 1, 0), 5001: (1, 1, 3), 5002: (1, 1, 5)}
    assert got[5001]["unique_dst_ports_per_src"] > 0                       # scan statistics came along
    stamp = {p: r["Timestamp"] for p, r in got.items()}
    day, clock = stamp[5001].split()
    h, m, s = map(int, clock.split(":"))
    early = f"{day} {h:02d}:{m:02d}:{s - 1:02d}" if s else stamp[5001]
    head = "Flow ID, Source IP, Source Port, Destination IP, Destination Port, Protocol, Timestamp, Total Fwd Packets, Label"
    table = [f"x,{b},80,{a},5000,6,{stamp[5000]},9, DoS Hulk ", f"y,{a},5001,{b},22,6,{early},1,PortScan"]
    (tmp_path / "l.csv").write_text("\n".join([head, *table]) + "\n")
    out = capture.labelled_export(flows, read_label_csv(spark, [str(tmp_path / "l.csv")]))
    assert {r["src_port"]: r["Label"] for r in out.collect()} == {5000: "DoS Hulk", 5001: "PortScan", 5002: "BENIGN"}
    assert not set(out.columns) & {*labels.HELPERS, "key", "start_pid", "label"}


def test_time_text_does_not_depend_on_the_session_zone(spark):
    rows = spark.createDataFrame([("12/03/2017 02:30:00",), ("5/7/2017 8:42",), ("junk",)], "t string")   # the first hour does not exist in New York
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Asia/Kathmandu"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert [r[0] for r in rows.select(contract.parse_timestamp(F.col("t"))).collect()] == [1489285800.0, 1499244120.0, None]
            twelve = spark.createDataFrame([("05/07/2017 12:30:00",)], "t string").select(contract.twelve_hour_seconds(F.col("t"))).first()[0]
            assert twelve == 1499214600                                   # half an hour after midnight
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_upload_without_a_valid_time_is_rejected(spark):
    names = [c for c in contract.REQUIRED if c != "flow_start_epoch"]
    rows = spark.createDataFrame([tuple("1" for _ in names) + ("no time",)], ", ".join(f"`{n}` string" for n in [*names, "Timestamp"]))
    with pytest.raises(contract.ContractError):
        serve.upload_windows(rows)


def test_as_of_join_spreads_one_key_in_one_hour(spark):
    """A third of both sides is one key within a minute; more ranges than keys, so answers come over the edges."""
    draw = random.Random(6)
    left = [(i, "hot" if i % 3 == 0 else f"k{i % 7}", draw.randrange(60) * 10 if i % 3 == 0 else draw.randrange(3000)) for i in range(900)]
    right = [(i, "hot" if i % 3 == 0 else f"k{i % 7}", draw.randrange(600) if i % 3 == 0 else draw.randrange(3000), f"L{i}") for i in range(900)]
    got = labels.nearest_in_time(spark.createDataFrame(left, "l bigint, key string, t bigint"), spark.createDataFrame(right, "r bigint, key string, t bigint, label string"),
                                 "key", "t", 4, "l", "r", ["label"])
    want = {}
    for i, key, t in left:
        fit = [(abs(t - u), u > t, -r if u <= t else r, r) for r, k, u, _ in right if k == key and abs(t - u) <= 4]
        if fit:
            want[i] = min(fit)[3]
    assert {r["l"]: r["r"] for r in got.collect()} == want and len(want) > 300
    parts = grouped.range_parts(spark.createDataFrame(right, "r bigint, key string, t bigint, label string"), ["key"], ["t", "r"], "t")
    sizes = [r["count"] for r in parts.where("key = 'hot'").groupBy("_part").count().collect()]
    assert len(sizes) > 1


def test_score_curves_with_most_scores_in_a_narrow_range(spark):
    draw = random.Random(2)
    data = [(int(draw.random() < 0.1), 0.5 + draw.random() * 1e-5 if draw.random() < 0.9 else draw.random()) for _ in range(3000)]
    counts = evaluate.score_counts(spark.createDataFrame([("m", y, p) for y, p in data], "m string, y_true int, y_prob double"), ["m"])
    curve = evaluate.score_curve(counts, ["m"])
    pos = neg = 0
    want = {}
    for y, p in sorted(data, key=lambda x: -x[1]):
        pos, neg = pos + y, neg + 1
        want[p] = (pos, neg)
    assert {r["score"]: (r["cum_pos"], r["cum_n"]) for r in curve.collect()} == want
    parts = grouped.range_parts(counts, ["m"], [F.col("score").desc()], "c")
    assert max(r["count"] for r in parts.groupBy("_part").count().collect()) < 0.6 * len(want)


def test_graph_history_pads_early_anchors(spark):
    nested = spark.createDataFrame([("d", i, [(-1, f"h{i}")]) for i in (0, 2, 3)], "day string, window_index bigint, nodes array<struct<o:int,host:string>>")
    anchors = spark.createDataFrame([("d", i) for i in (0, 3, 6)], "day string, window_index bigint")
    got = {r["window_index"]: ["".join(n["host"] for n in g) for g in r["graphs"]] for r in graph.gather_history(anchors, nested, ["day"], 4).collect()}
    assert got == {0: ["", "", "", "h0"], 3: ["h0", "", "h2", "h3"], 6: ["h3", "", "", ""]}


def test_mean_distribution_of_draws(spark):
    rows = [("a", 1, 0.2, [0.6, 0.2, 0.1, 0.1, 0.0]), ("a", 1, 0.4, [0.2, 0.2, 0.4, 0.1, 0.1]), ("a", 1, 0.9, [0.1, 0.0, 0.4, 0.4, 0.1])]
    r = forecast.draw_summary(spark.createDataFrame(rows, "id string, k int, prob double, dist array<double>"), ["id"], dist="dist").first()
    assert r["state_dist"] == pytest.approx([0.3, 0.4 / 3, 0.3, 0.2, 0.2 / 3]) and r["progression_state"] in ("NORMAL", "ONSET")
    assert (r["attack_ci_lo"], r["attack_ci_hi"]) == pytest.approx((0.21, 0.875))


def test_windows_leave_the_flows_where_they_are(spark, tmp_path):
    """With a broadcast limit far below the flows' size, windows still come without a shuffle of the flows."""
    path = str(tmp_path / "flows")
    spark.range(20_000).select((F.col("id") % 5).cast("string").alias("day"), (F.col("id") * 1.5).alias("flow_start_epoch"),
                               F.concat(F.lit("host-"), F.col("id")).alias("src_ip")).write.parquet(path)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        rows = ops.assign_windows(spark.read.parquet(path))
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "hashpartitioning(day" not in plan


def test_explainers_declare_their_own_columns(spark):
    class Extremes:
        """The span of each feature over the history, none for flat ones."""

        columns = "feature string, low double, high double"

        def explain(self, history):
            for name, column in zip(("a", "b"), zip(*history)):
                if min(column) < max(column):
                    yield name, min(column), max(column)

    anchors = spark.createDataFrame([("s", 4, [[1.0, 2.0], [3.0, 2.0]]), ("s", 5, [[0.0, 0.0], [0.0, 0.0]])], "session_id string, window_index bigint, x array<array<double>>")
    got = explain.explanations(anchors, Extremes(), ("session_id", "window_index"))
    assert got.columns == ["session_id", "window_index", "feature", "low", "high"] and dict(got.dtypes)["window_index"] == "bigint"
    assert [tuple(r) for r in got.collect()] == [("s", 4, "a", 1.0, 3.0)]


def test_upload_with_a_users_window_factory(spark):
    names = [c for c in contract.REQUIRED if c != "flow_start_epoch"]
    rows = spark.createDataFrame([tuple("1" for _ in names) + (t,) for t in ("05/07/2017 10:00:00", "05/07/2017 10:00:30")],
                                 ", ".join(f"`{n}` string" for n in [*names, "Timestamp"]))
    got = serve.upload_windows(rows, make_windows=lambda flows, cfg: flows.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.lit(cfg.window_seconds).alias("w")))
    assert [tuple(r) for r in got.collect()] == [("upload", 2, 10.0)]
