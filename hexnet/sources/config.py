"""Settings of an engine, from a mapping or a YAML file."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from ..errors import InvalidArgument
from .datasets import Dataset


@dataclass(frozen=True)
class Config:
    """root: of the store.  modes: routing mode -> factor, or None."""

    root: str
    graphs_prefix: str = "graph/"
    outputs_prefix: str = "outputs/"
    cache_size: int = 10
    datasets: dict[str, Dataset] = field(default_factory=dict)
    modes: dict[str, float | None] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, factor in self.modes.items():
            if factor is not None and not (math.isfinite(factor) and factor > 0):
                raise InvalidArgument(f"the factor of mode {name!r} must be a positive number")

    @classmethod
    def of(cls, data: dict) -> Config:
        root = data.get("objectstore", {}).get("root", data.get("root", "."))
        sets = {
            name: Dataset(f"{root}/{d.get('path', name)}", {int(a): int(b) for a, b in d["resolutions"].items()}, d.get("h3index_column_name", "h3index"), d.get("key_pattern", ""), d.get("schema", ""))
            for name, d in (data.get("datasets") or {}).items()
        }
        modes = {name: (m or {}).get("edge_preference_factor") for name, m in (data.get("routing_modes") or {}).items()}
        graphs, outputs = data.get("graphs") or {}, data.get("outputs") or {}
        return cls(root, graphs.get("prefix", "graph/"), outputs.get("prefix", "outputs/"), int(graphs.get("cache_size", 10)), sets, modes)

    @classmethod
    def load(cls, path: str) -> Config:
        try:
            import yaml
        except ImportError as e:
            raise InvalidArgument("reading YAML needs the yaml package") from e
        with open(path) as f:
            return cls.of(yaml.safe_load(f))
