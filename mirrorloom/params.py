"""Scan parameters and their checks."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

STRATEGIES = ("greedy", "score", "stability")


@dataclass(frozen=True)
class ScanParams:
    """Parameters of a scan; the defaults are those of the documented API."""

    minrep: int = 8
    maxrep: int = 1000
    maxspacer: int = 10
    purity: float = 0.90
    mismatch: float = 0.10
    remove_overlaps: bool = True
    overlap_strategy: str = "greedy"
    score: bool = True
    at_threshold: float | None = None
    min_g_rate: float = 0.20
    filter_homopolymers: bool = True

    def __post_init__(self) -> None:
        if self.minrep < 1:
            raise ValueError("minrep must be at least 1")
        if self.maxrep < self.minrep:
            raise ValueError("maxrep must not be below minrep")
        if self.maxspacer < 0:
            raise ValueError("maxspacer must not be negative")
        for name in ("purity", "mismatch"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie in [0, 1]")
        if self.overlap_strategy not in STRATEGIES:
            raise ValueError(f"unknown overlap strategy {self.overlap_strategy!r}")
        if self.remove_overlaps and self.overlap_strategy != "greedy" and not self.score:
            raise ValueError("selection by score needs scoring")

    def but(self, **changes) -> ScanParams:
        return replace(self, **changes)

    @property
    def purity_percent(self) -> int:
        return int(np.float32(self.purity) * np.float32(100) + np.float32(0.5))

    @property
    def mismatch_percent(self) -> int:
        return int(np.float32(self.mismatch) * np.float32(100) + np.float32(0.5))

    @property
    def mismatch_budget(self) -> int:
        return int(np.float32(self.mismatch) * np.float32(self.maxrep))
