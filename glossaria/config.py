"""Parameters of the operators; ``Config.check()`` names every value that is out of range."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from glossaria.constants import SEGMENT_WEIGHTS


@dataclass(frozen=True)
class Config:
    min_clean_chars: int = 40
    min_clean_chars_non_latin: int = 12
    dominant_script_share: float = 0.60
    max_segment_chars: int = 2000
    top_k: int = 5
    primary_min_score: float = 0.20
    secondary_min_score: float = 0.35
    secondary_min_ratio: float = 0.50
    secondary_weight: float = 0.20
    weights: dict[str, float] = field(default_factory=lambda: dict(SEGMENT_WEIGHTS))
    low_share: float = 0.50
    high_share: float = 0.65
    screen_ratio: float = 0.40
    screen_segments: int = 2
    credible_ratio: float = 0.50
    credible_segments: int = 3
    credible_top1: int = 1
    credible_types: int = 2
    credible_margin: float = 0.25
    credible_mean: float = 0.45
    credible_max: float = 0.70
    require_second_model: bool = True
    seed: str = "20260520"
    run_id: str = "default"
    buckets: int = 4096
    bucket_start: int = 0
    bucket_end: int = 4095
    segments_per_partition: int = 250_000
    min_partitions: int = 800
    max_partitions: int = 20_000
    videos_per_channel: int = 10

    def check(self) -> Config:
        bad = []
        for name in ("dominant_script_share", "primary_min_score", "secondary_min_score", "secondary_min_ratio", "secondary_weight", "low_share", "high_share", "screen_ratio", "credible_ratio", "credible_margin", "credible_mean", "credible_max"):
            if not 0 <= getattr(self, name) <= 1:
                bad.append(f"{name} must lie in 0..1")
        for name in ("min_clean_chars", "min_clean_chars_non_latin", "max_segment_chars", "top_k", "buckets", "segments_per_partition", "min_partitions", "videos_per_channel"):
            if getattr(self, name) < 1:
                bad.append(f"{name} must be 1 or more")
        if self.low_share > self.high_share:
            bad.append("low_share is above high_share")
        if not 0 <= self.bucket_start <= self.bucket_end < self.buckets:
            bad.append("buckets must satisfy 0 <= start <= end < buckets")
        if self.min_partitions > self.max_partitions:
            bad.append("min_partitions is above max_partitions")
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", self.run_id):
            bad.append("run_id has characters other than letters, digits, _ . -")
        if any(w < 0 for w in self.weights.values()):
            bad.append("weights must not be negative")
        if bad:
            raise ValueError("; ".join(bad))
        return self


def plan_partitions(segments: int, cfg: Config) -> int:
    return max(cfg.min_partitions, min(cfg.max_partitions, -(-segments // cfg.segments_per_partition)))
