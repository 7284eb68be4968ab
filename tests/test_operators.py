"""Hand rows and brute force for the operators."""

import random
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.config import FEATURES, STATES, AugmentConfig, SequenceConfig, SplitConfig, WindowConfig
from tidewatch.functions import columns as C
from tidewatch.functions import grouped as G
from tidewatch.operators import augment, clean, evaluate, forecast, labels, models, packets, phases, progression, reports, rules, sequences, splits
from tidewatch.operators import windows as ops
from tidewatch.sources import contract, tables


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def window_rows(spark, spec, day="d"):
    """spec: (index, attack flows, ratio, family)"""
    return rows(spark, [(day, i, 1000.0 + i * 10, a, float(r), f) for i, a, r, f in spec],
                "day string, window_index bigint, window_start double, attack_flows bigint, attack_ratio double, dominant_family string")


def states(spark, spec, **cfg):
    got = progression.progression_states(window_rows(spark, spec), replace(WindowConfig(smooth_radius=0), **cfg)).orderBy("window_index")
    return [r["progression_state"] for r in got.collect()]


B, H, G2 = (0, 0.0, "BENIGN"), (9, 0.9, "DoS Hulk"), (9, 0.9, "DoS GoldenEye")


def test_progression_pre_attack_family_change_and_tail(spark):
    spec = [(i, *x) for i, x in enumerate([B, B, B, B, H, H, G2, G2, (3, 0.2, "DoS GoldenEye"), B])]
    assert states(spark, spec) == ["NORMAL", "PRE_ATTACK", "PRE_ATTACK", "PRE_ATTACK", "ONSET", "ACTIVE", "CONTINUATION", "ACTIVE",
                                   "CONTINUATION", "NORMAL"]


def test_progression_gap_stops_pre_attack_but_not_the_episode(spark):
    spec = [(0, *B), (5, *B), (6, *B), (7, *H), (20, *H)]
    assert states(spark, spec) == ["NORMAL", "PRE_ATTACK", "PRE_ATTACK", "ONSET", "ACTIVE"]


def test_smoothing_majority(spark):
    flags = [H, B, H, B, B, H, B]
    got = progression.smooth_attack_flag(window_rows(spark, [(i, *x) for i, x in enumerate(flags)]), WindowConfig()).orderBy("window_index")
    raw = [1, 0, 1, 0, 0, 1, 0]
    want = [int(np.mean(raw[max(0, i - 1): i + 2]) >= 0.5) for i in range(len(raw))]
    assert [r["is_attack"] for r in got.collect()] == want


def test_idle_gap_is_filled_and_long_gap_stays(spark):
    base = rows(spark, [("d", i, 1000.0 + 10 * i, 3, "BENIGN") for i in (0, 1, 3, 70)],
                "day string, window_index bigint, window_start double, flow_count bigint, dominant_family string")
    got = ops.fill_idle(base, WindowConfig()).orderBy("window_index").collect()
    assert [r["window_index"] for r in got] == [0, 1, 2, 3, 70]
    assert (got[2]["flow_count"], got[2]["window_start"], got[2]["dominant_family"]) == (0, 1020.0, "BENIGN")


def test_split_episode_takes_one_trailing_row(spark):
    flags = [1, 1, 0, 0, 0, 1, 0, 0, 1]
    got = splits.split_episodes(rows(spark, [("d", i, a) for i, a in enumerate(flags)], "day string, window_index bigint, y_attack int"), 2)
    assert [r["episode"] for r in got.orderBy("window_index").collect()] == [1, 1, 1, None, None, 2, None, None, 3]


def test_short_episodes_rotate_per_family_and_long_ones_are_cut(spark):
    spec, i = [], 0
    for _ in range(5):
        spec += [(i, 1, "Bot"), (i + 1, 0, "BENIGN"), (i + 2, 0, "BENIGN")]
        i += 3
    spec += [(i + k, 1, "DDoS") for k in range(10)]
    df = rows(spark, [("d", a, y, f) for a, y, f in spec], "day string, window_index bigint, y_attack int, dominant_family string")
    got = splits.assign_split(df, SplitConfig(long_episode_windows=10), WindowConfig()).where("y_attack = 1").orderBy("window_index").collect()
    assert [r["split"] for r in got] == ["train", "val", "train", "test", "train"] + ["train"] * 6 + ["val"] * 2 + ["test"] * 2


def test_synthetic_windows_train_and_do_not_move_the_others(spark):
    df = rows(spark, [("d", i, 0, "BENIGN", 0) for i in range(10)], "day string, window_index bigint, y_attack int, dominant_family string, is_synthetic int")
    more = df.unionByName(rows(spark, [("__aug_Bot__", i, 1, "Bot", 1) for i in range(5)], df.schema))
    cfg = SplitConfig()
    alone = {(r["day"], r["window_index"]): r["split"] for r in splits.assign_split(df, cfg).collect()}
    both = {(r["day"], r["window_index"]): r["split"] for r in splits.assign_split(more, cfg).collect()}
    assert {k: v for k, v in both.items() if k[0] == "d"} == alone
    assert {v for k, v in both.items() if k[0] != "d"} == {"train"}


def sequence_windows(spark, n=14, split=lambda i: "train", gap_at=None):
    data = []
    for i in range(n):
        index = i if gap_at is None or i < gap_at else i + 5
        data.append(("d", index, 10.0 * index, 10.0, int(i % 4 == 0), i % 5, split(i), "Bot" if i % 4 == 0 else "BENIGN", float(i)))
    return rows(spark, data, "day string, window_index bigint, window_start double, time_since_prev_window double, y_attack int, "
                             "progression_idx int, split string, dominant_family string, flow_count double")


def test_sequences_contiguity_purity_and_checks(spark):
    cfg = SequenceConfig(history=3, horizon=2)
    df = sequence_windows(spark, split=lambda i: "train" if i < 7 else "test")
    got = sequences.build_sequences(df, cfg, features=("flow_count",)).orderBy("window_index").collect()
    assert [r["window_index"] for r in got] == list(range(2, 12))
    assert [r["split"] for r in got] == ["train"] * 3 + ["ignore"] * 4 + ["test"] * 3
    assert got[0]["x"] == [[0.0], [1.0], [2.0]] and got[0]["y_atk"] == [0, 1] and got[0]["x_next"] == [3.0]
    seqs = sequences.build_sequences(df, cfg, features=("flow_count",))
    sequences.check_sequences(seqs, df, cfg)
    loose = sequences.build_sequences(df, replace(cfg, purge_boundary=False), features=("flow_count",))
    with pytest.raises(sequences.LeakageError):
        sequences.check_sequences(loose, df, cfg)
    with pytest.raises(sequences.LeakageError):
        sequences.check_sequences(seqs.where("split = 'test'"), df, cfg)
    broken = sequences.build_sequences(sequence_windows(spark, gap_at=7), cfg, features=("flow_count",))
    assert sorted(r["window_index"] for r in broken.collect()) == [2, 3, 4, 14, 15, 16]


def test_scaler_against_numpy(spark):
    cfg = SequenceConfig(history=3, horizon=2)
    df = sequence_windows(spark, n=40)
    seqs = sequences.build_sequences(df, cfg, features=("flow_count",))
    flat = np.concatenate([np.array(r["x"]).ravel() for r in seqs.where("split = 'train'").collect()])
    want = (np.median(flat), np.subtract(*np.percentile(flat, [75, 25])))
    r = sequences.fit_scaler(seqs, df, cfg, ("flow_count",)).first()
    assert (r["median"], r["iqr"]) == pytest.approx(want)


def test_every_positive_sequence_can_be_a_mixup_partner(spark):
    train = rows(spark, [(i, [[float(i)]], [i % 2], [0]) for i in range(60)], "id bigint, x array<array<double>>, y_atk array<int>, y_prog array<int>")
    mates = augment.mixup_partners(train, ["id"], 7).collect()
    assert sorted(r["_mate_no"] for r in mates) == list(range(30))
    assert sorted(r["_mate"]["x"][0][0] for r in mates) == [float(i) for i in range(1, 60, 2)]


def test_pads_of_variants_differ_and_come_from_other_days(spark):
    flows = rows(spark, [(d, w, 0, "train", 0.0) for d in ("Monday", "Tuesday", "Wednesday") for w in range(12)],
                 "day string, _wi bigint, is_attack int, _split string, flow_start_epoch double")
    plan = rows(spark, [(f"p{i}", "Tuesday", "Bot", True, 1) for i in range(200)], "plan_id string, day string, attack_family string, rare boolean, v int")
    got = augment._pads(flows, plan, AugmentConfig(), 5).toPandas()
    assert (got.groupby("plan_id").size() == 5).all() and got.plan_id.nunique() == 200
    first = got.groupby("plan_id").agg(day=("day", "min"), last=("day", "max"), start=("_wi", "min"), end=("_wi", "max"))
    assert (first.day == first["last"]).all() and (first.end - first.start == 4).all()
    assert set(zip(first.day, first.start)) == {(d, w) for d in ("Monday", "Wednesday") for w in range(8)}
    assert augment._pads(flows.where("day = 'Tuesday'"), plan, AugmentConfig(), 5).count() == 0


def test_rows_repeat_by_their_weight(spark):
    from pyspark.ml.linalg import Vectors
    data = spark.createDataFrame([(Vectors.dense([float(i)]), 2.5 if i % 5 == 0 else 0.625) for i in range(1000)], ["features", "weight"])
    got = models.repeated(data).groupBy("weight").count().toPandas().set_index("weight")["count"]
    assert 460 < got[2.5] < 540 and 440 < got[0.625] < 560


def test_day_stays_without_a_source_name(spark):
    assert clean.assign_day(rows(spark, [("Monday",)], "day string")).first()["day"] == "Monday"
    assert clean.assign_day(rows(spark, [(1,)], "x int")).first()["day"] == "Unknown"


@pytest.mark.parametrize("values", [
    [1.0], [5.0, 5.0, 5.0], list(range(100)), [-3.5, 0.0, 2.25, 1e9, -1e-9, 7.0, 7.0], None])
def test_exact_quantiles_against_numpy(spark, values):
    rng = random.Random(7)
    values = values or [rng.gauss(0, 50) * 10 ** rng.randint(-3, 4) for _ in range(3000)]
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "v": [float(v) for v in values]}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    for group in (["g"], []):
        got = {r["p"]: r["q"] for r in G.exact_quantiles(df, group, "v", probs).collect()}
        assert [got[p] for p in probs] == pytest.approx([np.percentile(values, 100 * p) for p in probs], rel=1e-9, abs=1e-9)


def test_salted_join_equals_a_join(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    small = rows(spark, [(0, "a"), (1, "b"), (2, "c")], "k bigint, t string")
    want = sorted((r["id"], r["t"]) for r in df.join(small, "k").collect())
    assert sorted((r["id"], r["t"]) for r in G.salted_join(df, small, ["k"], F.col("id")).collect()) == want


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id")
    got = G.hash_rank(df, ["g"], C.unit_draw(1, F.col("id")), ["id"], "r", buckets=16).toPandas()
    for _, part in got.groupby("g"):
        assert sorted(part.r) == list(range(len(part))) and set(part.r_of) == {len(part)}


def test_number_text_equals_python(spark):
    values = [0.625, 0.145, 0.285, 0.165, 2.675, 0.005, 0.015, 1e-9, 123.455, 0.92, 0.5, 0.0, 99.995, 1234567.125]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [tuple(r) for r in df.select(C.number_text(F.col("v")), C.percent_text(F.col("v"))).collect()]
    assert got == [(f"{v:.2f}", f"{v:.1%}") for v in values]


def test_labels_and_days(spark):
    df = rows(spark, [("  DDoS ",), (None,), ("",), ("Web Attack – Brute Force",), ("Port Scan",), ("Other x",)], "Label string")
    assert [r[0] for r in df.select(C.attack_family(F.col("Label"))).collect()] == [
        "DDoS", "BENIGN", "BENIGN", "Web Attack Brute Force", "PortScan", "Other x"]
    days = rows(spark, [("friday-x.csv",), ("THURSDAY",), ("x",)], "s string")
    assert [r[0] for r in days.select(C.day_name(F.col("s"))).collect()] == ["Friday", "Thursday", "Unknown"]


def test_contract_headers_and_bad_upload(spark):
    got = contract.match_columns([" Src IP", "dst ip", "Destination Port", "Protocol", "Flow Duration", "Flow IAT Mean", "Tot Fwd Pkts",
                                  "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Timestamp", "SYN Flag Count", "Label", "weird"])
    assert got["ok"] and got["labelled"] and got["time_axis_from_text"] and got["extra"] == ["weird"]
    assert got["aliased"]["dst ip"] == "Destination IP" and got["flags"] == {"flag_true_syn": "SYN Flag Count"}
    assert contract.match_columns(["foo"])["required_missing"] == list(contract.REQUIRED)
    with pytest.raises(contract.ContractError):
        contract.normalise_upload(rows(spark, [(1, 2)], "foo int, bar int"))
    head = ", ".join(f"`{c}` string" for c in contract.REQUIRED)
    blank = rows(spark, [tuple("x" for _ in contract.REQUIRED)], head)
    with pytest.raises(contract.ContractError):
        contract.require_rows(contract.normalise_upload(blank))
    assert contract.match_report(spark, ["Src IP"]).where("item = 'alias'").first()["column"] == "Source IP"


def test_csv_sources_and_sinks(spark, tmp_path):
    (tmp_path / "Monday-a.csv").write_text("flow_start_epoch, Source IP,Label\n1.5,10.0.0.1,BENIGN\n")
    (tmp_path / "Friday-b.csv").write_text("Source IP,flow_start_epoch,Label,Extra\n10.0.0.2,2.5,Bot,7\n")
    got = tables.read_flow_csv(spark, [str(tmp_path / "none.csv")], [str(tmp_path / "Monday-a.csv"), str(tmp_path / "Friday-b.csv")])
    out = {r["Source IP"]: (r["flow_start_epoch"], r["Label"], r["Extra"]) for r in got.collect()}
    assert out == {"10.0.0.1": ("1.5", "BENIGN", None), "10.0.0.2": ("2.5", "Bot", "7")}
    with pytest.raises(FileNotFoundError):
        tables.read_flow_csv(spark, [str(tmp_path / "none.csv")])
    flows = clean.clean_flows(got.withColumn("source_file", F.element_at(F.split("source_path", "/"), -1)))
    tables.write_table(flows, str(tmp_path / "flows"), sort=("flow_start_epoch",))
    back = tables.read_or_build(spark, str(tmp_path / "flows"), None)
    assert {(r["day"], r["attack_family"]) for r in back.collect()} == {("Monday", "BENIGN"), ("Friday", "Bot")}
    tables.write_report(reports.upload_histograms(back.withColumn("protocol", F.lit(6))), str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).count() == 3
    tables.write_documents(back, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    message = '{"type":"flows","session_id":"s","records":[{"flow_start_epoch":1.0,"Source IP":"a"},{"flow_start_epoch":2.0}]}'
    recs = tables.flow_records(rows(spark, [(message,), ('{"type":"ping"}',)], "value string")).collect()
    assert [(r["session_id"], r["flow_start_epoch"]) for r in recs] == [("s", 1.0), ("s", 2.0)]


ANCHOR = "alert boolean, max_attack_prob double, lead_time_seconds double, horizon array<struct<k:int,horizon_seconds:double,progression_state:string,attack_prob:double>>, syn_ratio double, flow_count double"


def test_rules(spark):
    anchors = rows(spark, [(True, 0.9, 20.0, [(1, 10.0, "NORMAL", 0.9), (2, 20.0, "ONSET", 0.75)], 0.92, 50.0),
                           (False, 0.1, 0.0, [(1, 10.0, "NORMAL", 0.1)], 0.1, 50.0)], ANCHOR)
    rs = rules.RuleSet()
    assert rs.definitions(spark).count() == 5
    got = [[(m["rule_id"], m["matched_value"]) for m in r["matched_rules"]] for r in rs.evaluate(anchors).collect()]
    assert got[0] == [("RULE-SEC-001", "SYN flag ratio 92.0% across 50 flows in window"),
                      ("RULE-AI-004", "Predicted ONSET at +20s with P(attack)=75.0%"),
                      ("RULE-AI-005", "Lead time 20s remaining with high-confidence probability 90.0%")]
    assert got[1] == []
    assert rs.set_enabled("RULE-SEC-001", False) and not rs.set_enabled("NOPE", True)
    assert [m["rule_id"] for m in rs.evaluate(anchors).first()["matched_rules"]] == ["RULE-AI-004", "RULE-AI-005"]
    rs.register(rules.Rule("MY-1", "mine", "LOW", "", "", "", lambda have: F.col("flow_count") > 10, lambda have: F.lit("x")))
    assert rs.match_table(anchors, ["flow_count"]).where("rule_id = 'MY-1'").count() == 2


def test_window_phases(spark):
    spec = [("NORMAL", "BENIGN", 0.0), ("PRE_ATTACK", "PortScan", 0.01), ("PRE_ATTACK", "DoS Hulk", 0.0), ("ONSET", "DoS Hulk", 0.5),
            ("ACTIVE", "DoS Hulk", 0.1), ("CONTINUATION", "DoS GoldenEye", 0.5), ("ACTIVE", "Strange", 0.9)]
    df = rows(spark, [("d", i, s, f, r) for i, (s, f, r) in enumerate(spec)],
              "day string, window_index bigint, progression_state string, dominant_family string, attack_ratio double")
    got = phases.window_phases(df).orderBy("window_index").collect()
    assert [(r["attck_phase"], r["attck_confidence"], r["attck_techniques"]) for r in got] == [
        ("None", "High", ""), ("Reconnaissance", "Medium", "T1595;T1590"), ("Reconnaissance", "Low", "T1590"),
        ("Impact", "Medium", "T1499;T1499.002"), ("Impact", "Medium", "T1499;T1499.002"), ("Impact", "Medium", "T1499;T1499.002"),
        ("Unknown", "Low", "")]
    assert got[5]["attck_family_transition"] == "DoS Hulk -> DoS GoldenEye" and got[4]["attck_family_transition"] is None


def test_one_to_one_matches_and_nearest(spark):
    left = rows(spark, [(1, "k", 100), (2, "k", 100), (3, "k", 103), (4, "k", 500), (5, "j", 100)], "l bigint, key string, t bigint")
    right = rows(spark, [(10, "k", 100, "A"), (11, "k", 100, "B"), (12, "k", 105, "C"), (13, "k", 101, "D")], "r bigint, key string, t bigint, label string")
    assert [tuple(x) for x in labels.first_pairs(left, right, ["key", "t"], "l", "r").collect()] == [(1, 10, "A")]
    near = labels.nearest_in_time(left, right, "key", "t", 2, "l", "r", ["label"])
    assert sorted((x["l"], x["r"]) for x in near.collect()) == [(1, 11), (2, 11), (3, 13)]
    one = labels.first_per_right(near, "l", "r", "t", ["label"])
    assert sorted((x["l"], x["r"]) for x in one.collect()) == [(1, 11), (3, 13)]


def test_scores_with_ties_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    df = rows(spark, [("m", y, p) for y, p in data], "m string, y_true int, y_prob double")
    r = evaluate.binary_scores(df, ["m"], 0.5).first()
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    auroc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    ap, best, prev = 0.0, 0.0, 0.0
    for t in sorted({p for _, p in data}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        rec, prec = tp / len(pos), tp / (tp + fp)
        ap += (rec - prev) * prec
        prev, best = rec, max(best, 2 * tp / (tp + fp + len(pos)))
    assert (r["auroc"], r["pr_auc"], r["f1_best"]) == pytest.approx((auroc, ap, best))
    grid = np.linspace(0.01, 0.99, 197)

    def at(t):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        return 2 * tp / max(tp + fp + len(pos), 1), fp / len(neg)
    allowed = [(t, at(t)[0]) for t in grid if at(t)[1] <= 0.15]
    want = max(allowed, key=lambda x: (x[1], -x[0]))[0]
    got = evaluate.calibrate_threshold(evaluate.score_counts(df, ["m"]), ["m"]).first()["threshold"]
    assert got == pytest.approx(want)
    one_class = evaluate.score_counts(df.where("y_true = 0"), ["m"])
    assert evaluate.calibrate_threshold(one_class, ["m"]).first()["threshold"] == 0.5
    assert evaluate.ranking(one_class, ["m"]).first()["auroc"] is None


def test_lead_time_is_per_day(spark):
    spec = [("a", 1, 0, 0.9), ("a", 2, 0, 0.9), ("a", 3, 1, 0.9), ("b", 1, 0, 0.9), ("b", 3, 0, 0.9), ("b", 4, 1, 0.1), ("b", 9, 1, 0.1)]
    df = rows(spark, spec, "day string, window_index bigint, y_now int, y_prob double")
    got = {r["day"]: r["lead_seconds"] for r in evaluate.lead_times(df, ["day"], 10.0, 0.5, 6).collect()}
    assert got == {"a": 20.0, "b": 10.0}
    s = evaluate.lead_summary(evaluate.lead_times(df, ["day"], 10.0, 0.5, 6), []).first()
    assert (s["n_episodes"], s["mean_lead_time_s"], s["detection_rate"]) == (2, 15.0, 1.0)


def test_forecast_columns(spark):
    df = rows(spark, [([0.1, 0.8, 0.9],), ([0.1, 0.2, 0.3],)], "p array<double>")
    got = df.select(*[c.alias(n) for n, c in forecast.alert_columns(F.col("p"), 3, 10.0, 0.7).items()]).collect()
    assert [(r["first_alert_k"], r["alert"], r["lead_time_seconds"]) for r in got] == [(2, True, 20.0), (None, False, 0.0)]
    dist = rows(spark, [({s: (0.6 if s == "ACTIVE" else 0.1) for s in STATES},)], "d map<string,double>")
    assert dist.select(forecast.top_state(F.col("d"))).first()[0] == "ACTIVE"
    table = rows(spark, [("NORMAL", 1, "ONSET", 0.4), ("NORMAL", 1, "NORMAL", 0.6)], "state string, k int, next string, prob double")
    steps = forecast.state_forecast(rows(spark, [(1, "NORMAL"), (2, "ACTIVE")], "id int, progression_state string"), table, 2)
    got = {(r["id"], r["k"]): (r["forecast_state"], r["attack_prob"]) for r in steps.collect()}
    assert got == {(1, 1): ("NORMAL", 0.4), (1, 2): ("NORMAL", 0.0), (2, 1): ("ACTIVE", 1.0), (2, 2): ("ACTIVE", 1.0)}


def test_guess_needs_a_clear_margin(spark):
    def guess(**z):
        df = rows(spark, [(0,)], "i int")
        got = forecast.choose_family(forecast.guess_family(df, lambda n: F.lit(float(z.get(n, 0.0)))))
        r = got.first()
        return r["guess"], r["guess_confidence"], r["family"]
    assert guess() == ("BENIGN", "Low", "BENIGN")
    assert guess(unique_dst_ports=9.0) == ("PortScan", "Low", "BENIGN")
    assert guess(unique_dst_ports=20.0) == ("PortScan", "Medium", "PortScan")


def test_augmented_flows_keep_the_rules(spark):
    rng = random.Random(5)
    data, fid = [], 0
    for day in ("Monday", "Tuesday"):
        for w in range(120):
            attack = day == "Monday" and 40 <= w < 44
            for _ in range(6):
                fid += 1
                bad = int(attack and rng.random() < 0.7)
                data.append((fid, day, 1000.0 + w * 10 + rng.random() * 9, rng.choice([80, 443, 22, 8080]), 100.0, bad, "Bot" if bad else "BENIGN"))
    flows = rows(spark, data, "flow_id bigint, day string, flow_start_epoch double, dst_port int, flow_duration double, is_attack int, attack_family string")
    windows = spark.range(120).select(F.explode(F.array(F.lit("Monday"), F.lit("Tuesday"))).alias("day"), F.col("id").alias("window_index"), F.lit("train").alias("split"))
    cfg, seq = AugmentConfig(cap_fraction=2.0), SequenceConfig(history=4, horizon=2)
    out = augment.augment_flows(flows, windows, cfg, seq, WindowConfig())
    pdf = out.toPandas()
    real, made = pdf[pdf.is_synthetic == 0], pdf[pdf.is_synthetic == 1]
    assert len(real) == len(data) and set(made.day) == {"__aug_Bot__"}
    attacks = made[made.is_attack == 1]
    source = flows.where("is_attack = 1").count()
    assert 2 <= len(attacks) <= 2 * source
    # variants are separated by the long gap and start at 0
    t = np.sort(made.flow_start_epoch.to_numpy())
    assert t[0] == 0.0 and (np.diff(t) > 1000.0).sum() == 1
    share = attacks.flow_duration / 100.0
    assert share.between(0.85, 1.15).all() and share.std() > 0
    assert (made[made.is_attack == 0].flow_duration == 100.0).all()
    again = augment.augment_flows(flows.repartition(7), windows, cfg, seq, WindowConfig()).toPandas()
    cols = ["day", "flow_start_epoch", "flow_id"]
    assert pdf.sort_values(cols)[cols].reset_index(drop=True).equals(again.sort_values(cols)[cols].reset_index(drop=True))


def test_sequence_augmentation_and_rebalance(spark):
    data = [(i, [[float(i), 1.0]] * 5, [0.5] * 5, [int(i % 10 == 0), 0], [2, 0]) for i in range(200)]
    df = rows(spark, data, "id bigint, x array<array<double>>, dt array<double>, y_atk array<int>, y_prog array<int>")
    got = augment.augment_sequences(df, ["id"]).toPandas()
    assert len(got) == 200 and all(len(x) == 5 and len(x[0]) == 2 for x in got.x)
    assert (got.y_atk.map(max) == [int(i % 10 == 0) for i in got.id]).all()
    share = augment.rebalance(df, ["id"], 0.3).agg(F.avg((F.array_max("y_atk") > 0).cast("double"))).first()[0]
    assert 0.2 < share < 0.4


def test_user_predictor_and_models(spark):
    rng = random.Random(1)
    data = []
    for i in range(120):
        y = i % 2
        data.append((i, [[rng.gauss(3 * y, 1), rng.random()]] * 3, [0.1] * 3, [y, 0]))
    df = rows(spark, data, "id bigint, x array<array<double>>, dt array<double>, y_atk array<int>")
    fitted = models.fit_horizons(df, "logistic_regression", 2)
    assert fitted.steps[1] == 0.0
    got = models.predict(df, fitted).toPandas()
    assert np.mean([(p[0] > 0.5) == y[0] for p, y in zip(got.attack_prob, got.y_atk)]) > 0.85
    assert models.importance(fitted, 0, ("a", "b"))[0][0] == "a"


def test_scan_statistics_rows(spark):
    df = rows(spark, [(i, 1000.0 + i * 0.1, "h", p) for i, p in enumerate([10, 11, 12, 20, 21, 5])], "pkt_id bigint, ts double, src_ip string, dport int")
    r = packets.scan_statistics(df, ["pkt_id"]).first()
    assert (r["port_scan_max_sequential_run"], r["unique_dst_ports_per_src"], r["port_scan_sequential_ratio"]) == (2, 6, pytest.approx(0.6))


def test_feature_contract(spark):
    assert len(FEATURES) == 53 and len(set(FEATURES)) == 53
    assert len(contract.FLOW_NUMBERS) == 63 and len(contract.PACKET_NUMBERS) == 26


@pytest.mark.parametrize("seed", [1, 2])
def test_episode_chrono_against_plain_loop(spark, seed):
    rng = random.Random(seed)
    spec, index = [], 0
    for _ in range(80):
        index += 1 if rng.random() < 0.9 else 4
        spec.append((index, int(rng.random() < 0.25)))
    df = rows(spark, [("d", i, a, "Bot" if a else "BENIGN") for i, a in spec],
              "day string, window_index bigint, y_attack int, dominant_family string")
    eps = [r["episode"] for r in splits.split_episodes(df, 2).orderBy("window_index").collect()]
    wi = [i for i, _ in spec]
    want = ["train"] * len(spec)
    for e in sorted({x for x in eps if x is not None}):
        at = [k for k, x in enumerate(eps) if x == e]
        i, j = at[0], at[-1]
        lo, width = max(0, i - 6), None
        width = max(wi[j] - wi[i] + 1 + i - lo, 1)
        for k in range(lo, min(j + 7, len(spec))):
            part = (wi[k] - wi[lo]) / width
            want[k] = "train" if part <= 0.6 else "val" if part <= 0.8 else "test"
    got = splits.assign_split(df, SplitConfig(mode="episode_chrono", benign_sample=0.0), WindowConfig()).orderBy("window_index").collect()
    assert [r["split"] for r in got] == want
    some = splits.assign_split(df, SplitConfig(mode="episode_chrono", benign_sample=1.0), WindowConfig()).where("y_attack = 0").collect()
    assert {r["split"] for r in some} == {"val", "test"}
