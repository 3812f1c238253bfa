"""Typed settings; unknown or invalid ones are refused."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path


class Settings:
    """Base of the records below: from a dict, refusing keys that they do not have."""

    @classmethod
    def from_dict(cls, values: dict):
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"{cls.__name__} has no {sorted(unknown)}")
        return cls(**values)

    @classmethod
    def load(cls, path: str):
        """From a JSON file, or YAML where that library is there."""
        text = Path(path).read_text()
        if path.endswith(".json"):
            return cls.from_dict(json.loads(text))
        import yaml

        return cls.from_dict(yaml.safe_load(text) or {})


def _one_of(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} {value!r} is none of {sorted(map(str, allowed))}")


@dataclass
class Camera(Settings):
    model: str = "PINHOLE"
    params: list[float] | None = None
    fixed: bool = False
    intrinsics_json: str | None = None
    single: bool = True

    def resolve(self, sequence: str | None = None) -> list[float] | None:
        """The parameters given, or [fx, fy, cx, cy] of an intrinsics file whose name may hold ``{sequence}``."""
        if self.intrinsics_json is None:
            return self.params
        held = json.loads(Path(fill(self.intrinsics_json, sequence)).read_text())
        return [float(held[k]) for k in ("fx", "fy", "cx", "cy")]


def fill(template: str, sequence: str | None) -> str:
    if ("{sequence}" in template) != (sequence is not None):
        raise ValueError(f"{template!r} and sequence {sequence!r} do not go together")
    return template.replace("{sequence}", sequence) if sequence is not None else template


@dataclass
class Matching(Settings):
    mode: str = "exhaustive"
    overlap: int = 10
    loop_detection: bool = False

    def __post_init__(self):
        _one_of("mode", self.mode, {"exhaustive", "sequential"})


@dataclass
class Attach(Settings):
    sensor: str = "depth"
    method: str = "unimodal"
    params: dict = field(default_factory=dict)


@dataclass
class DepthAdjustment(Settings):
    sensor: str = "depth"
    depth_space: str = "log"
    sigma: float = 0.05
    huber_scale: float | None = 2.0
    shared_scale: bool = False
    per_image_scale: bool = True
    per_image_shift: bool = False
    alpha_init: str = "median"
    placement: str = "all"
    prior_sigma_alpha: float | None = None
    prior_sigma_beta: float | None = None

    def __post_init__(self):
        _one_of("depth_space", self.depth_space, {"log", "linear", "inverse"})
        _one_of("alpha_init", self.alpha_init, {"unit", "median"})
        _one_of("placement", self.placement, {"global", "local", "all"})
        if self.sigma <= 0:
            raise ValueError("sigma must be positive")

    def active(self, in_global: bool) -> bool:
        """Whether depth factors take part in a global or a local adjustment."""
        return self.placement == "all" or self.placement == ("global" if in_global else "local")
