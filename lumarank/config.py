"""Configuration: defaults, merging and validation that reports every error at once."""

from __future__ import annotations

import copy
from typing import Any

from lumarank.constants import SCENE_WEIGHTS, VISION_DIMS

DEFAULTS: dict[str, Any] = {
    "grouping": {"gap_seconds": 30.0, "merge_gap_seconds": 600.0, "max_hash_bits": 10, "min_cosine": 0.9},
    "scoring": {"prior_weight": 0.10, "pixel_weight": 0.3, "vision_weight": 0.7, "group_floor": 6.0, "review_fallback": True},
    "sharpness": {"min_variance": 50.0, "max_variance": 1000.0},
    "exposure": {"over_ratio": 1.0, "under_ratio": 1.0},
    "labels": {"min_labels": 20, "min_span": 0.1, "holdout_percent": 20},
    "scene_weights": SCENE_WEIGHTS,
}
#: Lowest and highest allowed value of numeric settings.
RANGES = {
    "grouping.gap_seconds": (0.0, 86400.0), "grouping.merge_gap_seconds": (0.0, 604800.0), "grouping.max_hash_bits": (0, 64), "grouping.min_cosine": (-1.0, 1.0),
    "scoring.prior_weight": (0.0, 0.6), "scoring.pixel_weight": (0.0, 1.0), "scoring.vision_weight": (0.0, 1.0), "scoring.group_floor": (0.0, 10.0),
    "sharpness.min_variance": (0.0, 1e9), "sharpness.max_variance": (0.0, 1e9), "exposure.over_ratio": (0.01, 100.0), "exposure.under_ratio": (0.01, 100.0),
    "labels.min_labels": (1, 1_000_000), "labels.min_span": (0.1, 9.0), "labels.holdout_percent": (0, 100),
}


def merged(base: dict[str, Any], changes: dict[str, Any], keep: str | None = None) -> dict[str, Any]:
    """``base`` with ``changes`` at any depth; values equal to ``keep`` (a mask) leave the old one."""
    out = copy.deepcopy(base)
    for k, v in changes.items():
        if keep is not None and v == keep:
            continue
        out[k] = merged(out[k], v, keep) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def errors(config: dict[str, Any]) -> list[str]:
    """All that is wrong with a configuration, in the order of its settings."""
    found = []
    for name, (low, high) in RANGES.items():
        part, key = name.split(".")
        value = config.get(part, {}).get(key)
        if isinstance(value, bool) or not isinstance(value, (int, float)) or not low <= value <= high:
            found.append(f"{name} must be from {low} to {high}, not {value!r}")
    sharp = config.get("sharpness", {})
    if not found and sharp["min_variance"] >= sharp["max_variance"]:
        found.append("sharpness.min_variance must be below max_variance")
    if not found and config["scoring"]["pixel_weight"] + config["scoring"]["vision_weight"] <= 0:
        found.append("scoring weights must not both be 0")
    weights = config.get("scene_weights", {})
    if "default" not in weights:
        found.append("scene_weights needs a default")
    for scene, own in weights.items():
        unknown = sorted(set(own) - set(VISION_DIMS))
        if unknown:
            found.append(f"scene_weights.{scene}: unknown {', '.join(unknown)}")
        if any(isinstance(v, bool) or not isinstance(v, (int, float)) or v < 0 for v in own.values()):
            found.append(f"scene_weights.{scene}: weights are numbers of at least 0")
    return found


def load(changes: dict[str, Any] | None = None) -> dict[str, Any]:
    """Defaults with changes; one error that names all that is wrong."""
    out = merged(DEFAULTS, changes or {})
    wrong = errors(out)
    if wrong:
        raise ValueError("; ".join(wrong))
    return out
