"""Thresholds and switches, as one object that a caller may override."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Rules:
    # The published limits.
    max_spine_tilt_deg: float = 6.3629
    vb_axis_limit_deg: float = 6.3629
    coverage_threshold: float = 0.524754
    artifact_feature: str | None = "kp_art_frac_mean"
    artifact_threshold: float = 0.0004318

    @classmethod
    def load(cls, path: str) -> Rules:
        """The defaults with what a JSON file of the same names overrides; a missing file changes nothing."""
        found = json.loads(Path(path).read_text()) if Path(path).exists() else {}
        return replace(cls(), **{f.name: found[f.name] for f in fields(cls) if f.name in found})

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps({f.name: getattr(self, f.name) for f in fields(self)}, indent=1))
