"""Settings from YAML or JSON files, over the fixed defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from geoloom.functions.scalars import WEIGHTS
from geoloom.operators import temporal


@dataclass(frozen=True)
class Settings:
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    drift: float = temporal.DRIFT
    limit: float = temporal.LIMIT
    min_obs: int = temporal.MIN_OBS
    rocchio: tuple[float, float, float] = (1.0, 0.75, 0.25)


def load(path: str) -> Settings:
    """Ranking weights, temporal limits and feedback factors; what a file leaves out keeps its default."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text) or {}
    base, ranking, times, feedback = Settings(), found.get("ranking", {}), found.get("temporal", {}), found.get("rocchio", {})
    weights = {k: float(ranking.get(k, v)) for k, v in base.weights.items()}
    if abs(sum(weights.values()) - 1) > 1e-6:
        raise ValueError("ranking weights must sum to 1")
    factors = tuple(float(feedback.get(k, v)) for k, v in zip(("alpha", "beta", "gamma"), base.rocchio, strict=True))
    return Settings(weights, float(times.get("drift", base.drift)), float(times.get("limit", base.limit)), int(times.get("min_obs", base.min_obs)), factors)
