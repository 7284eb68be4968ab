"""Detection rules: a registry of predicate / detail Column pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.columns import number_text, percent_text


@dataclass
class Rule:
    rule_id: str
    name: str
    severity: str
    description: str
    mitre_technique: str
    action: str
    predicate: Callable[[set], Column]  # gets the names of the available columns
    detail: Callable[[set], Column]
    enabled: bool = True


def first_filled(*names: str) -> Callable[[set], Column]:
    """Value of the first column that is present, not NULL and not 0; else 0."""
    def build(have):
        cols = [F.when(F.col(n) != 0, F.col(n).cast("double")) for n in names if n in have]
        return F.coalesce(*cols, F.lit(0.0))
    return build


class RuleSet:
    """Rules in registration order; disabled ones are left out when the plan is built."""

    def __init__(self, with_defaults: bool = True):
        self.rules: dict[str, Rule] = {}
        if with_defaults:
            for rule in default_rules():
                self.register(rule)

    def register(self, rule: Rule) -> None:
        self.rules[rule.rule_id] = rule

    def set_enabled(self, rule_id: str, enabled: bool) -> bool:
        if rule_id not in self.rules:
            return False
        self.rules[rule_id].enabled = enabled
        return True

    def definitions(self, spark) -> DataFrame:
        rows = [(r.rule_id, r.name, r.severity, r.description, r.mitre_technique, r.action, r.enabled) for r in self.rules.values()]
        return spark.createDataFrame(rows, "rule_id string, rule_name string, severity string, description string, "
                                           "mitre_technique string, action string, enabled boolean")

    def evaluate(self, anchors: DataFrame) -> DataFrame:
        """Add ``matched_rules``: array of matches in registration order."""
        have = set(anchors.columns)
        found = []
        for r in self.rules.values():
            if not r.enabled:
                continue
            found.append(F.struct(
                F.coalesce(r.predicate(have), F.lit(False)).alias("matched"),
                F.lit(r.rule_id).alias("rule_id"), F.lit(r.name).alias("rule_name"), F.lit(r.severity).alias("severity"),
                F.lit(r.description).alias("description"), F.lit(r.mitre_technique).alias("mitre_technique"),
                F.lit(r.action).alias("action"), r.detail(have).alias("matched_value")))
        if not found:
            return anchors.withColumn("matched_rules", F.expr(
                "cast(array() as array<struct<matched:boolean,rule_id:string,rule_name:string,severity:string,"
                "description:string,mitre_technique:string,action:string,matched_value:string>>)"))
        return anchors.withColumn("matched_rules", F.filter(F.array(*found), lambda m: m["matched"]))

    def match_table(self, anchors: DataFrame, keep: list[str]) -> DataFrame:
        """One row per (anchor, matching rule)."""
        rows = self.evaluate(anchors).select(*keep, F.explode("matched_rules").alias("m"))
        return rows.select(*keep, "m.rule_id", "m.rule_name", "m.severity", "m.mitre_technique", "m.action", "m.matched_value")


def rule_features(windows: DataFrame) -> DataFrame:
    """Inputs of the traffic rules from raw windows: SYN share, port entropy over its maximum, bytes per second."""
    top = F.log2(F.col("unique_dst_ports").cast("double"))
    return windows.withColumns({
        "port_entropy": F.when(F.col("unique_dst_ports") > 1, F.col("dstport_entropy") / F.when(top > 0, top)).otherwise(0.0),
        "bytes_per_sec": F.col("byte_rate")})


def default_rules() -> list[Rule]:
    syn, flows = first_filled("syn_ratio"), first_filled("flow_count")
    entropy = first_filled("port_entropy", "dst_port_entropy")
    octets, packets = first_filled("bytes_per_sec", "fwd_bytes_rate"), first_filled("packet_rate", "fwd_pkt_rate")

    def onset(_):
        hits = F.filter("horizon", lambda h: h["progression_state"].isin("ONSET", "ACTIVE") & (h["attack_prob"] >= 0.70))
        return F.get(hits, F.lit(0))

    def certainty(have):
        probs = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("max_detection_prob", "max_attack_prob") if c in have]
        return F.greatest(*probs) if len(probs) > 1 else (probs[0] if probs else F.lit(0.0))

    def if_there(have, needed, build):
        return build() if needed <= have else F.lit(False)

    def text_if_there(have, needed, build):
        return build() if needed <= have else F.lit("")

    horizon, lead = {"horizon"}, {"alert", "lead_time_seconds"}
    # Ids, names, texts and limits of the five rules.
    return [
        Rule("RULE-SEC-001", "Aggressive TCP SYN Scan", "HIGH",
             "High concentration of SYN packets without ACK completion, characteristic of reconnaissance scans.",
             "T1046: Network Service Discovery",
             "Apply source IP rate-limiting and verify against external threat intel feeds.",
             lambda have: (syn(have) >= 0.70) & (flows(have) >= 25),
             lambda have: F.concat(F.lit("SYN flag ratio "), percent_text(syn(have)), F.lit(" across "),
                                   flows(have).cast("long").cast("string"), F.lit(" flows in window"))),
        Rule("RULE-SEC-002", "Network Port Sweep", "MEDIUM",
             "Unusually high entropy across target ports indicating horizontal or vertical port scanning.",
             "T1046: Network Service Discovery",
             "Review targeted port range in firewall logs; trigger temporary port block.",
             lambda have: (entropy(have) >= 0.85) & (flows(have) >= 20),
             lambda have: F.concat(F.lit("Normalized port distribution entropy "), number_text(entropy(have)),
                                   F.lit(" (threshold: 0.85)"))),
        Rule("RULE-SEC-003", "High-Volume Data Velocity", "HIGH",
             "Abrupt outbound byte transfer surge exceeding typical operational baseline.",
             "T1048: Exfiltration Over Alternative Protocol",
             "Isolate egress socket and inspect destination IP geolocations.",
             lambda have: (octets(have) >= 5e6) | ((octets(have) >= 2e6) & (packets(have) >= 1000)),
             lambda have: F.concat(F.lit("Outbound throughput spiked to "), number_text(octets(have) / 1e6), F.lit(" MB/s"))),
        Rule("RULE-AI-004", "Predictive Attack Onset Trigger", "CRITICAL",
             "World Model forward trajectory projects attack onset before completion of adversary kill chain.",
             "T1190: Exploit Public-Facing Application",
             "Engage Incident Response Playbook and stage automated endpoint isolation.",
             lambda have: if_there(have, horizon, lambda: onset(have).isNotNull()),
             lambda have: text_if_there(have, horizon, lambda: F.concat(
                 F.lit("Predicted "), onset(have)["progression_state"], F.lit(" at +"),
                 onset(have)["horizon_seconds"].cast("long").cast("string"), F.lit("s with P(attack)="),
                 percent_text(onset(have)["attack_prob"])))),
        Rule("RULE-AI-005", "Imminent Critical Trajectory", "CRITICAL",
             "Alert triggered within immediate horizon (<= 20s lead time) with high model certainty.",
             "T1499: Endpoint DoS",
             "Execute automated defensive containment.",
             lambda have: if_there(have, lead, lambda: F.col("alert") & (F.col("lead_time_seconds") > 0)
                                   & (F.col("lead_time_seconds") <= 20) & (certainty(have) >= 0.85)),
             lambda have: text_if_there(have, lead, lambda: F.concat(
                 F.lit("Lead time "), F.col("lead_time_seconds").cast("long").cast("string"),
                 F.lit("s remaining with high-confidence probability "), percent_text(certainty(have))))),
    ]
