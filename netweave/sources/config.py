"""Settings: defaults, dotted look-up, and a check that tells all errors at
once."""

from __future__ import annotations

import copy
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "project": {"name": "network", "crs": "EPSG:32643", "out": "out"},
    "topology": {"weld_tolerance_m": 1.0, "min_dangle_m": 2.0, "min_edge_m": 1.0, "max_bridge_m": 150.0},
    "demand": {"population": None, "lpcd": 135.0, "total_lpd": None, "losses": 0.0, "peak_factor": 2.5, "method": "voronoi", "max_service_distance_m": 150.0},
    "hydraulics": {"ladder_mm": [40, 50, 75, 100, 150, 200, 250, 300, 350, 400], "default_mm": 50.0, "cap_mm": 50.0, "label_distance_m": 60.0, "max_velocity": 1.5, "min_residual_m": 15.0},
    "placement": {"k": 5, "seed": 42, "low": 0.2, "high": 0.8, "floor": 5, "classes": ["dead_end", "junction"]},
}


class ConfigError(ValueError):
    """All that is wrong with the settings."""


def merge(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merge(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


class Config:
    def __init__(self, values: dict | None = None):
        self.values = merge(DEFAULTS, values or {})

    @classmethod
    def load(cls, path: str) -> Config:
        """From YAML, or JSON where no YAML library is installed."""
        text = Path(path).read_text()
        try:
            import yaml

            return cls(yaml.safe_load(text) or {})
        except ImportError:
            import json

            return cls(json.loads(text))

    def get(self, dotted: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in dotted.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def validate(self) -> Config:
        errors = []
        need = lambda ok, text: None if ok else errors.append(text)
        ladder = self.get("hydraulics.ladder_mm") or []
        need(ladder == sorted(ladder) and ladder, "hydraulics.ladder_mm: sizes in rising order are needed")
        need(0 < self.get("placement.low", 0) < self.get("placement.high", 0) < 1, "placement.low and high: 0 < low < high < 1")
        need(isinstance(self.get("placement.k"), int) and self.get("placement.k") >= 1, "placement.k: a number of zones from 1")
        need(self.get("demand.total_lpd") or self.get("demand.population"), "demand: a population or total_lpd")
        need((self.get("demand.peak_factor") or 0) > 0, "demand.peak_factor: above 0")
        need((self.get("hydraulics.max_velocity") or 0) > 0, "hydraulics.max_velocity: above 0")
        need(str(self.get("project.crs", "")).upper().startswith("EPSG:"), "project.crs: EPSG:number")
        if errors:
            raise ConfigError("; ".join(errors))
        return self

    @property
    def out(self) -> Path:
        path = Path(self.get("project.out"))
        path.mkdir(parents=True, exist_ok=True)
        return path


COLUMN_NAMES = {"elevation_m": ("elev", "elevation", "z"), "demand_lps": ("demand", "base_demand"), "pressure_m": ("pressure", "press"), "node_id": ("id", "node", "name")}


def match_column(columns: list[str], wanted: str) -> str | None:
    """The column that is meant: by name, by a synonym, or nearly so."""
    from difflib import get_close_matches

    low = {c.lower(): c for c in columns}
    for name in (wanted, *COLUMN_NAMES.get(wanted, ())):
        if name.lower() in low:
            return low[name.lower()]
    close = get_close_matches(wanted.lower(), list(low), n=1, cutoff=0.82)
    return low[close[0]] if close else None
