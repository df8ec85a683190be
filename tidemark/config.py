"""Parameter records. All are frozen so that they can be shipped to tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

from tidemark import fixed_values as fv


@dataclass(frozen=True)
class GridSpec:
    step_seconds: int = fv.STEP_SECONDS
    length: int = fv.SAMPLES_PER_WEEK
    offset_days: int = 0

    @property
    def offset_slots(self) -> int:
        return self.offset_days * 86400 // self.step_seconds


@dataclass(frozen=True)
class SplitSpec:
    train: int = 9
    val: int = 3
    threshold: int = 2

    @property
    def used(self) -> int:
        return self.train + self.val + self.threshold


@dataclass(frozen=True)
class ScorerSpec:
    threshold_method: str = "percentile"
    percentile: float = 95.0
    sigma: float = 3.0
    ridge: float = 1e-6
    mode: str = "point"
    hard_k: int = 5

    def __post_init__(self):
        if self.threshold_method not in ("percentile", "sigma"):
            raise ValueError(f"unknown threshold method: {self.threshold_method}")
        if self.mode not in ("point", "window"):
            raise ValueError(f"unknown scoring mode: {self.mode}")
        # 0 means "use the default" for all three.
        for name, default in (("percentile", 95.0), ("sigma", 3.0), ("hard_k", 5)):
            if not getattr(self, name):
                object.__setattr__(self, name, default)


@dataclass(frozen=True)
class InjectSpec:
    kinds: tuple = ("point", "level_shift", "temporal")
    copies: int = 1
    point_count: int = 5
    point_magnitude: float = 3.0
    level_fraction: float = 0.3
    level_magnitude: float = 2.0
    noise_fraction: float = 0.3
    noise_scale: float = 0.0
    shift_hours: int = 6
    seed: int = 42

    @staticmethod
    def with_magnitude(m: float, kinds=("point", "level_shift"), **rest) -> "InjectSpec":
        """One magnitude for all kinds; noise takes 0.6 of it."""
        return InjectSpec(kinds=tuple(kinds), point_magnitude=m, level_magnitude=m, noise_scale=0.6 * m, **rest)


@dataclass(frozen=True)
class ModelSpec:
    input_dim: int = 1
    hidden: int = 64
    layers: int = 1
    dropout: float = 0.2
    length: int = fv.SAMPLES_PER_WEEK

    @property
    def parameter_count(self) -> int:
        total = 0
        for layer in range(self.layers):
            width = self.input_dim if layer == 0 else self.hidden
            total += 2 * (4 * self.hidden * (width + self.hidden) + 8 * self.hidden)
        return total + self.hidden * self.input_dim + self.input_dim


@dataclass(frozen=True)
class TrainSpec:
    epochs: int = 100
    rate: float = 1e-3
    patience: int = 10
    min_delta: float = 1e-6
    weight_decay: float = 0.0
    clip: float = 1.0
    batch: int = 4
    seed: int = 42


@dataclass(frozen=True)
class LocaliseSpec:
    scales_hours: tuple = field(default_factory=lambda: tuple(fv.SCALES_HOURS))
    report_hours: int = fv.REPORT_SCALE_HOURS
    per_hour: int = fv.SAMPLES_PER_HOUR
    error_level: float = fv.ERROR_LEVEL
    spike_multiple: float = fv.SPIKE_MULTIPLE
    top: int = 3
