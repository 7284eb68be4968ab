"""Offline chain: flows -> state windows -> split -> sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.config import WindowConfig
from tidewatch.operators.phases import window_phases
from tidewatch.operators.progression import progression_states
from tidewatch.operators.windows import (
    aggregate_windows, assign_windows, fill_idle, guard_features, time_features,
)


def state_windows(flows: DataFrame, cfg: WindowConfig = WindowConfig(), keys=("day",)) -> DataFrame:
    """Windows with the 53 features, progression state and attack phase."""
    keys = list(keys)
    rows = aggregate_windows(assign_windows(flows, cfg, keys), cfg, keys)
    rows = fill_idle(rows, cfg, keys)
    rows = progression_states(rows, cfg, keys)
    rows = window_phases(rows, cfg, keys)
    return guard_features(time_features(rows, cfg, keys))
