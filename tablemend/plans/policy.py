"""Repair policy: one frozen set of switches, with three presets (PRO11)."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


# The defaults of the switches.
@dataclass(frozen=True)
class RepairPolicy:
    mode: str = "gentle"
    drop_identifier_columns: bool = False
    drop_leakage_columns: bool = False
    drop_high_missing_columns: bool = False
    missing_column_threshold: float = 0.98
    remove_duplicates: bool = False
    handle_outliers: bool = False
    outlier_percentile: float = 95
    outlier_method: str = "isolation_forest"
    outlier_action: str = "cap"
    convert_mixed_numeric_text: bool = False
    encode_features: bool = False
    apply_log_transform: bool = False
    apply_transformation: bool = False
    transformation_method: str = "auto"
    apply_normalization: bool = False
    normalization_method: str = "standard"
    skew_threshold: float = 1.0
    numeric_imputation: str = "auto"
    correct_label_noise: bool = False

    def merge(self, **changes) -> RepairPolicy:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown policy switches: {sorted(unknown)}")
        return replace(self, **changes)


# What each mode changes in the gentle policy.
PRESETS = {
    "gentle": {},
    "balanced": {
        "missing_column_threshold": 0.95,
        "encode_features": True,
        "handle_outliers": True,
        "apply_log_transform": True,
    },
    "aggressive": {
        "missing_column_threshold": 0.90,
        "encode_features": True,
        "handle_outliers": True,
        "outlier_action": "remove",
        "apply_log_transform": True,
        "apply_transformation": True,
        "apply_normalization": True,
    },
}


def policy_for(mode: str = "gentle", **changes) -> RepairPolicy:
    if mode not in PRESETS:
        raise ValueError(f"unknown mode {mode!r}; there are {sorted(PRESETS)}")
    return RepairPolicy(mode=mode).merge(**PRESETS[mode]).merge(**changes)
