"""Estimator settings and the duration arithmetic derived from them."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class EstimatorConfig:
    """Immutable settings of the short-recording reliability estimator.

    ``k_factor`` is the lengthening factor handed to the Spearman-Brown formula: how many
    short recordings fit into the target duration.
    """

    n_channels: int = 400
    tr: float = 1.0
    short_duration_sec: float = 120
    target_duration_min: float = 15
    n_networks: int = 7
    n_bootstraps: int = 100
    reliability_coeff: float = 0.98
    empirical_prior: tuple[float, float] | None = (0.25, 0.05)
    observation_var: float = 0.15
    seed: int = 42
    fc_density: float = 0.15

    @property
    def short_samples(self) -> int:
        return math.floor(self.short_duration_sec / self.tr)

    @property
    def target_samples(self) -> int:
        return math.floor(self.target_duration_min * 60 / self.tr)

    @property
    def k_factor(self) -> float:
        return self.target_samples / self.short_samples
