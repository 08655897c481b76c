"""Frozen settings with layered loading: defaults, file, overlay, environment, overrides."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from dataclasses import dataclass, field, fields, is_dataclass


# The defaults below are fixed values of the domain.


@dataclass(frozen=True)
class Split:
    strategy: str = "temporal"
    train: float = 0.6
    val: float = 0.15
    test: float = 0.25
    held_out_institution: str | None = None

    def __post_init__(self):
        if self.strategy not in ("temporal", "random", "institution"):
            raise ValueError(f"unknown split strategy {self.strategy!r}")
        if abs(self.train + self.val + self.test - 1) > 1e-6:
            raise ValueError("split fractions must sum to one")
        if self.strategy == "institution" and not self.held_out_institution:
            raise ValueError("the institution split needs held_out_institution")


@dataclass(frozen=True)
class Features:
    rolling_window_steps: int = 5
    fan_in_threshold: int = 6
    fan_out_threshold: int = 6
    scaler: str = "standard"
    use_graph: bool = False
    use_temporal: bool = False
    use_motif: bool = False

    def __post_init__(self):
        if self.scaler not in ("standard", "robust", "minmax", "none"):
            raise ValueError(f"unknown scaler {self.scaler!r}")


@dataclass(frozen=True)
class Model:
    name: str = "boosted_trees"
    hidden_dim: int = 64
    motif_weight: float = 0.5
    num_layers: int = 2
    dropout: float = 0.1
    fanout: tuple[int, ...] = (15, 10)
    depth: int = 6
    trees: int = 300


@dataclass(frozen=True)
class Training:
    learning_rate: float = 1e-3
    weight_decay: float = 1e-5
    batch_size: int = 512
    epochs: int = 50
    patience: int = 5
    alert_threshold: float = 0.5
    alert_budget: int | None = None


@dataclass(frozen=True)
class Federated:
    num_clients: int = 4
    rounds: int = 20
    local_epochs: int = 1
    fraction: float = 1.0
    proximal_mu: float = 0.01
    boundary_rounds: int = 2


@dataclass(frozen=True)
class Privacy:
    target_epsilon: float = 8.0
    delta: float = 1e-5
    clip: float = 1.0
    noise: float = 1.1
    masked: bool = False

    def __post_init__(self):
        if not 0 < self.delta < 1:
            raise ValueError("delta must lie between 0 and 1")


@dataclass(frozen=True)
class Evaluation:
    precision_at_k: tuple[int, ...] = (50, 100, 500)
    sweep_steps: int = 19


@dataclass(frozen=True)
class Serving:
    rate_limit: int = 100
    rate_window_seconds: int = 60


@dataclass(frozen=True)
class Settings:
    dataset: str = "ibm_aml"
    raw_dir: str = "data/raw"
    processed_dir: str = "data/processed"
    seed: int = 42
    split: Split = field(default_factory=Split)
    features: Features = field(default_factory=Features)
    model: Model = field(default_factory=Model)
    training: Training = field(default_factory=Training)
    federated: Federated = field(default_factory=Federated)
    privacy: Privacy = field(default_factory=Privacy)
    evaluation: Evaluation = field(default_factory=Evaluation)
    serving: Serving = field(default_factory=Serving)

    def to_dict(self) -> dict:
        return dataclasses.asdict(self)

    def hash(self) -> str:
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True, default=str).encode()).hexdigest()


#: Feature families and model of the named profiles.
PROFILES = {
    "baseline": {},
    "neighbour_mean": {"features": {"use_graph": True, "use_temporal": True}, "model": {"name": "neighbour_mean"}},
    "attention": {"features": {"use_graph": True, "use_temporal": True, "use_motif": True}, "model": {"name": "neighbour_mean", "num_layers": 3}},
}
PREFIX = "TALLYWEFT__"


def merged(low: dict, high: dict) -> dict:
    """A deep merge; the right side wins."""
    out = dict(low)
    for k, v in high.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _built(cls, values: dict):
    known = {f.name: f for f in fields(cls)}
    if extra := set(values) - set(known):
        raise ValueError(f"unknown settings of {cls.__name__}: {sorted(extra)}")
    made = {}
    for k, v in values.items():
        default = known[k].default_factory() if known[k].default_factory is not dataclasses.MISSING else known[k].default
        made[k] = _built(type(default), v) if is_dataclass(default) and isinstance(v, dict) else tuple(v) if isinstance(default, tuple) else v
    return cls(**made)


def from_environment(environ: dict | None = None) -> dict:
    """TALLYWEFT__SECTION__KEY=value, values read as JSON where they are."""
    out: dict = {}
    for name, text in (os.environ if environ is None else environ).items():
        if name.startswith(PREFIX):
            at = out
            *path, last = name.removeprefix(PREFIX).lower().split("__")
            for p in path:
                at = at.setdefault(p, {})
            try:
                at[last] = json.loads(text)
            except ValueError:
                at[last] = text
    return out


def load(path: str | None = None, overlay: dict | str | None = None, overrides: dict | None = None, environ: dict | None = None) -> Settings:
    """Settings from a JSON file, an overlay (a dict or a profile's name), the environment and overrides, in rising order."""
    values: dict = {}
    if path:
        with open(path) as f:
            values = json.load(f)
    layer = PROFILES[overlay] if isinstance(overlay, str) else overlay or {}
    for more in (layer, from_environment(environ), overrides or {}):
        values = merged(values, more)
    return _built(Settings, values)
