"""Window and forecast -> attack tactic, technique list, phase and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import ATTACK_STATES, BENIGN, WindowConfig
from tidewatch.functions.columns import first_match, number_text

# --------------------------------------------------------------------------
# Knowledge base (family, tactic, techniques, phase, confidence, note).
# --------------------------------------------------------------------------
KNOWLEDGE = (
    ("BENIGN", "None", "", "None", "High", "all flows benign"),
    ("PortScan", "Reconnaissance / Discovery", "T1595;T1046", "Reconnaissance", "High",
     "sequential/randomised port sweep is an unambiguous recon signature"),
    ("FTP-Patator", "Credential Access / Initial Access", "T1110;T1190", "Initial Access", "Medium",
     "brute force against a service; tactic depends on success"),
    ("SSH-Patator", "Credential Access / Initial Access", "T1110;T1021", "Initial Access", "Medium",
     "brute force against SSH; Remote Services if it lands"),
    ("Web Attack Brute Force", "Credential Access", "T1110.004", "Initial Access", "Medium",
     "credential stuffing over HTTP"),
    ("Web Attack XSS", "Initial Access", "T1190", "Initial Access", "Medium", "exploit of a public-facing app"),
    ("Web Attack SQL Injection", "Initial Access / Execution", "T1190;T1059", "Initial Access", "Medium",
     "exploit + possible command execution"),
    ("Heartbleed", "Initial Access / Credential Access", "T1190", "Initial Access", "Medium",
     "memory disclosure via a vulnerable TLS service"),
    ("DoS Hulk", "Impact", "T1499;T1499.002", "Impact", "High", "HTTP flood -> endpoint DoS"),
    ("DoS GoldenEye", "Impact", "T1499;T1499.002", "Impact", "High", "HTTP keep-alive flood -> endpoint DoS"),
    ("DoS slowloris", "Impact", "T1499;T1499.003", "Impact", "High", "partial-request exhaustion (low-and-slow)"),
    ("DoS Slowhttptest", "Impact", "T1499;T1499.003", "Impact", "High", "slow-body exhaustion (low-and-slow)"),
    ("DDoS", "Impact", "T1498", "Impact", "High", "volumetric network DoS"),
    ("Bot", "Command and Control", "T1071;T1572", "Command & Control", "Medium", "beaconing to a C2 server"),
    ("Infiltration", "Initial Access -> Discovery -> Lateral Movement", "T1190;T1046;T1021", "Lateral Movement",
     "Medium", "external compromise then internal scanning from the victim host"),
)
UNKNOWN = ("Unknown", "", "Unknown", "Low", "family not in knowledge base")
RECON_LIKE = ("PortScan", "Infiltration")
CONFIDENCE = ("Low", "Medium", "High")
# tactic and phase when an attack is forecast without a family
STATE_ONLY = {
    "ONSET": ("Execution / Initial Access", "Exploitation"),
    "ACTIVE": ("Impact", "Actions on Objectives"),
    "CONTINUATION": ("Impact / Persistence", "Actions on Objectives"),
}
# Rationale texts (printf arguments are families, ratios or the look-ahead span).
TEXTS = {
    "NORMAL": "window contains only BENIGN flows",
    "PRE_RECON": "benign-labelled window %d steps before a confirmed %s onset; scan-shaped precursor",
    "PRE_OTHER": "benign window immediately preceding a %s onset; no confirmed malicious flow yet"
                 " - staging/ramp-up inferred from timing only",
    "ONSET": "first window carrying a confirmed %s label; tactic per knowledge base but downgraded"
             " - single-window evidence (attack_ratio=%s)",
    "ACTIVE": "sustained %s activity (attack_ratio=%s); %s",
    "TURN": "tactic transition %s -> %s; adversary changed technique within the same episode",
    "TAIL": "%s episode tail (attack_ratio=%s); activity persisting or winding down",
    "STEP": "forecast +%ss (step k=%s); P(state)=%s, P(attack)=%s. ",
    "NO_FAMILY": "attack forecast without a family label; tactic derived from the progression state only."
                 " Pass a `family_hint` on upload for precise ATT&CK technique mapping. ",
    "GUESSED": "family inferred from window feature profile (no labelled flow): likely %s. ",
}

KB_SCHEMA = "_fam string, _tactic string, _techniques string, _phase string, _conf string, _note string"


def with_knowledge(rows: DataFrame, family: str) -> DataFrame:
    """Left join of the 15-row table; a family outside it becomes Unknown / Low."""
    table = F.broadcast(rows.sparkSession.createDataFrame(list(KNOWLEDGE), KB_SCHEMA))
    joined = rows.join(table, F.col(family) == F.col("_fam"), "left").drop("_fam")
    names = ("_tactic", "_techniques", "_phase", "_conf", "_note")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(d)) for n, d in zip(names, UNKNOWN)})


def lower(confidence: Column, steps) -> Column:
    """Confidence ``steps`` notches down, never under Low."""
    steps = steps if isinstance(steps, Column) else F.lit(steps)
    level = first_match([(confidence == c, i) for i, c in enumerate(CONFIDENCE)], 1)
    left = F.greatest(level - steps, F.lit(0))
    return F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), (left + 1).cast("int"))


def previous_family(windows: DataFrame, keys=("day",)) -> DataFrame:
    """Family of the last attack window since the last NORMAL window; PRE_ATTACK keeps it."""
    order = W.partitionBy(*keys).orderBy("window_index")
    since = windows.withColumn("_reset", F.sum((F.col("progression_state") == "NORMAL").cast("int")).over(order))
    attack_family = F.when(F.col("progression_state").isin(*ATTACK_STATES), F.col("dominant_family"))
    back = W.partitionBy(*keys, "_reset").orderBy("window_index").rowsBetween(W.unboundedPreceding, -1)
    return since.withColumn("prev_family", F.last(attack_family, ignorenulls=True).over(back)).drop("_reset")


def _assess(rows: DataFrame, state: Column, family: Column, previous: Column, share: Column,
            span: int) -> dict[str, Column]:
    """Assessment columns; needs ``with_knowledge`` columns on ``rows``."""
    recon = family.isin(*RECON_LIKE)
    pre = state == "PRE_ATTACK"
    turn = (state == "CONTINUATION") & previous.isNotNull() & (previous != family) & (family != BENIGN)
    normal = state == "NORMAL"
    share_text = number_text(share)
    return {
        "tactic": first_match([
            (normal, "None"), (pre & recon, "Reconnaissance"), (pre, "Reconnaissance (inferred)")], F.col("_tactic")),
        "techniques": first_match([
            (normal, ""), (pre & recon, "T1595;T1590"), (pre, "T1590")], F.col("_techniques")),
        "phase": first_match([(normal, "None"), (pre, "Reconnaissance")], F.col("_phase")),
        "confidence": first_match([
            (normal, "High"), (pre & recon, "Medium"), (pre, "Low"),
            ((state == "ACTIVE") & (share >= 0.15), F.col("_conf")),
        ], lower(F.col("_conf"), 1)),
        "transition": F.when(turn, F.concat(previous, F.lit(" -> "), family)),
        "rationale": first_match([
            (normal, TEXTS["NORMAL"]),
            (pre & recon, F.format_string(TEXTS["PRE_RECON"], F.lit(span), family)),
            (pre, F.format_string(TEXTS["PRE_OTHER"], family)),
            (state == "ONSET", F.format_string(TEXTS["ONSET"], family, share_text)),
            (state == "ACTIVE", F.format_string(TEXTS["ACTIVE"], family, share_text, F.col("_note"))),
            (turn, F.format_string(TEXTS["TURN"], previous, family)),
        ], F.format_string(TEXTS["TAIL"], family, share_text)),
    }


def window_phases(windows: DataFrame, cfg: WindowConfig = WindowConfig(), keys=("day",)) -> DataFrame:
    """Add the six ``attck_*`` columns to windows that carry a progression state."""
    rows = with_knowledge(previous_family(windows, keys), "dominant_family")
    got = _assess(rows, F.col("progression_state"), F.col("dominant_family"), F.col("prev_family"),
                  F.col("attack_ratio"), cfg.pre_attack_span)
    names = {"tactic": "attck_tactic", "techniques": "attck_techniques", "phase": "attck_phase",
             "confidence": "attck_confidence", "rationale": "attck_rationale",
             "transition": "attck_family_transition"}
    return rows.withColumns({new: got[old] for old, new in names.items()}).drop(
        "_tactic", "_techniques", "_phase", "_conf", "_note", "prev_family")


def forecast_phases(steps: DataFrame, cfg: WindowConfig = WindowConfig()) -> DataFrame:
    """Phase of every forecast step.

    Needs ``k, progression_state, state_prob, attack_prob, family, family_inferred, prev_family``.
    Confidence falls by 1 + (k-1) div 3 notches, one more when the family was guessed.
    """
    rows = with_knowledge(steps, "family")
    state, family = F.col("progression_state"), F.col("family")
    got = _assess(rows, state, family, F.col("prev_family"), F.col("attack_prob"), cfg.pre_attack_span)
    blind = state.isin(*ATTACK_STATES) & (family == BENIGN)
    guessed = F.col("family_inferred") & (family != BENIGN) & ~blind
    down = (F.lit(1) + F.floor(F.greatest(F.col("k") - 1, F.lit(0)) / 3)).cast("int")
    head = F.format_string(TEXTS["STEP"], (F.col("k") * int(cfg.window_seconds)).cast("string"),
                           F.col("k").cast("string"), number_text(F.col("state_prob")), number_text(F.col("attack_prob")))
    return rows.withColumns({
        "attck_tactic": first_match([(blind & (state == s), t) for s, (t, _) in STATE_ONLY.items()], got["tactic"]),
        "attck_phase": first_match([(blind & (state == s), p) for s, (_, p) in STATE_ONLY.items()], got["phase"]),
        "attck_techniques": F.when(blind, "").otherwise(got["techniques"]),
        "attck_confidence": lower(first_match([
            (blind, "Low"), (guessed, lower(got["confidence"], 1))], got["confidence"]), down),
        "attck_family_transition": got["transition"],
        "attck_rationale": F.concat(head, first_match([
            (blind, F.concat(F.lit(TEXTS["NO_FAMILY"]), got["rationale"])),
            (guessed, F.concat(F.format_string(TEXTS["GUESSED"], family), got["rationale"])),
        ], got["rationale"])),
    }).drop("_tactic", "_techniques", "_phase", "_conf", "_note")
