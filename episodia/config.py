"""Settings: strict nested dataclasses, layered YAML, duration strings."""

from __future__ import annotations

import dataclasses
import os
import re
from dataclasses import dataclass, field
from datetime import datetime
from pathlib import Path
from typing import Any

import yaml

_UNITS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000}


def micros(value: str | int | float) -> int:
    """'10min', '7D', '1h', '30s' (or seconds as a number) in microseconds."""
    if isinstance(value, (int, float)):
        return round(value * 1_000_000)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*(us|ms|s|min|h|D)\s*", value)
    if not m:
        raise ValueError(f"not a duration: {value!r}")
    return round(float(m[1]) * _UNITS[m[2]])


@dataclass(frozen=True)
class Event:
    id: int
    start: datetime
    end: datetime
    maintenance: datetime | None = None


@dataclass(frozen=True)
class Region:
    start: datetime
    end: datetime


@dataclass(frozen=True)
class SplitSettings:
    embargo: str = "24h"
    pre_margin: str = "24h"
    post_settle: str = "24h"
    fallback_post: str = "48h"
    regions: tuple[Region, ...] = ()
    min_train_days: float = 30.0


@dataclass(frozen=True)
class EvaluationSettings:
    widths_h: tuple[float, ...] = (6, 12, 24, 48, 72)
    quantile: float = 0.995
    quantiles: tuple[float, ...] = (0.99, 0.995, 0.999)
    hold: str = "10min"
    score_gap: str = "30min"
    min_duration: str = "0s"
    aggregation: str = "mean"
    permutation_samples: int = 500
    chance_threshold: float = 0.10
    pooled_buffer: str = "24h"
    false_alarm_ceiling: float = 0.3
    events: tuple[Event, ...] = ()


@dataclass(frozen=True)
class RegimeSettings:
    #: state -> {flag: value}; the first that holds wins
    states: dict[str, dict[str, float]] = field(default_factory=lambda: {"LOADED": {"COMP": 0.0}})
    split_channel: str = "Motor_current"
    split_at: float = 2.0
    above: str = "OFFLOAD"
    below: str = "STOPPED"
    min_duration: str = "30s"
    settle: str = "20s"
    transition: str = "TRANSITION"


@dataclass(frozen=True)
class FeatureSettings:
    decay_channel: str = "Reservoirs"
    min_samples: int = 3
    gap: str = "1min"
    baseline: str = "7D"
    duty: str = "1h"
    lag: str = "14D"


@dataclass(frozen=True)
class ScalingSettings:
    method: str = "robust"
    zero_epsilon: float = 1e-8
    min_samples: int = 100
    warn_factor: float = 100.0
    channels: tuple[str, ...] = ("TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Oil_temperature", "Motor_current")
    passthrough: tuple[str, ...] = ("COMP", "DV_eletric", "Towers", "MPG", "LPS", "Pressure_switch", "Oil_level", "Caudal_impulses")
    active: dict[str, tuple[str, ...]] = field(default_factory=dict)


@dataclass(frozen=True)
class WindowSettings:
    window: str = "30min"
    stride_train: str = "5min"
    stride_score: str = "1min"
    tolerance: float = 0.1
    gap: str = "5min"
    resample: str | None = None


@dataclass(frozen=True)
class RuleSettings:
    baseline: str = "7D"
    mode: str = "trailing"
    lag: str = "14D"
    enabled: tuple[str, ...] = ("short_stopped_duration", "fast_pressure_decay", "low_peak_pressure", "high_duty_ratio")


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 200
    max_samples: int = 256
    seed: int = 42
    stats: tuple[str, ...] = ("mean", "std", "min", "max", "slope")
    cycle_features: bool = True
    ablation: bool = False


@dataclass(frozen=True)
class ReconstructionSettings:
    kind: str = "convolutional"  # or "linear"
    bottleneck: int = 8
    widths: tuple[int, ...] = (32, 16)
    kernel: int = 5
    dropout: float = 0.0
    activation: str = "relu"
    learning_rate: float = 1e-3
    batch: int = 64
    epochs: int = 50
    patience: int = 5
    validation: float = 0.15
    minutes: float = 30.0
    max_windows: int = 20_000
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    split: SplitSettings = SplitSettings()
    evaluation: EvaluationSettings = EvaluationSettings()
    regimes: RegimeSettings = RegimeSettings()
    features: FeatureSettings = FeatureSettings()
    scaling: ScalingSettings = ScalingSettings()
    windows: WindowSettings = WindowSettings()
    rules: RuleSettings = RuleSettings()
    forest: ForestSettings = ForestSettings()
    reconstruction: ReconstructionSettings = ReconstructionSettings()


def merged(base: dict, over: dict) -> dict:
    """`over` laid on `base`: mappings are merged by key, everything else (lists too) replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def read_yaml(path: str | Path) -> dict:
    """The mapping in a YAML file; {} if empty."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no settings file {path}")
    return yaml.safe_load(Path(path).read_text()) or {}


def build(kind: type, values: dict[str, Any]) -> Any:
    """A settings dataclass from a mapping; an unknown key is an error at every level."""
    known = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"unknown settings in {kind.__name__}: {', '.join(unknown)}")
    out = {}
    for name, value in values.items():
        nested = globals().get({"split": "SplitSettings", "evaluation": "EvaluationSettings", "regimes": "RegimeSettings", "features": "FeatureSettings", "scaling": "ScalingSettings", "windows": "WindowSettings", "rules": "RuleSettings", "forest": "ForestSettings", "reconstruction": "ReconstructionSettings"}.get(name, "")) if kind is Settings else None
        if nested is not None and isinstance(value, dict):
            value = build(nested, value)
        elif name == "events":
            value = tuple(build(Event, v) for v in value)
        elif name == "regions":
            value = tuple(build(Region, v) for v in value)
        elif isinstance(value, list):
            value = tuple(value)
        out[name] = value
    return kind(**out)


def load(folder: str | Path, name: str | None = None, experiment: str | Path | None = None) -> Settings:
    """base.yaml, then <name>.yaml (given, else $CONFIG, else 'local'), then an experiment file."""
    name = name or os.environ.get("CONFIG") or "local"
    values = read_yaml(Path(folder) / "base.yaml")
    if name != "base":
        values = merged(values, read_yaml(Path(folder) / f"{name}.yaml"))
    if experiment:
        values = merged(values, read_yaml(experiment))
    return build(Settings, values)
