"""The contract between a reconstruction model and the scorer."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import ScorerSpec
from tidemark.plans import flows
from tidemark.session import Sized
from tidemark.sources.artifacts import model_stats, scorer_stats


class Detector(Protocol):
    """What batch, stream and sweep need from a detector."""

    min_rows: int

    def detect(self, windows: DataFrame) -> DataFrame: ...

    def get_stats(self) -> DataFrame: ...

    def is_ready(self) -> bool: ...


def run(detector: Detector, windows: DataFrame) -> DataFrame:
    """Flags of the windows that are long enough for ``detector``; an unfitted one is an error."""
    if not detector.is_ready():
        raise ValueError("the detector has no threshold: fit it first")
    return detector.detect(windows.filter(F.size("values") >= detector.min_rows))


@dataclass(frozen=True)
class ProfileDetector:
    """Seasonal profile as reconstruction."""

    params: DataFrame | Sized
    scorer: ScorerSpec
    by: tuple
    min_rows: int

    def detect(self, windows: DataFrame) -> DataFrame:
        return flows.score_windows(windows, self.params, self.scorer, list(self.by))

    def get_stats(self) -> DataFrame:
        return scorer_stats(self.params, list(self.by), self.scorer.ridge)

    def is_ready(self) -> bool:
        return bool({"threshold", "point_threshold"} & set(_table(self.params).columns))


@dataclass(frozen=True)
class LstmDetector:
    """Encoder-decoder as reconstruction."""

    models: DataFrame | Sized
    params: DataFrame | Sized
    scorer: ScorerSpec
    by: tuple
    min_rows: int

    def detect(self, windows: DataFrame) -> DataFrame:
        return flows.score_lstm_windows(windows, self.models, self.params, self.scorer, list(self.by))

    def get_stats(self) -> DataFrame:
        return model_stats(self.models, list(self.by))

    def is_ready(self) -> bool:
        return bool({"threshold", "point_threshold"} & set(_table(self.params).columns))


def _table(params: DataFrame | Sized) -> DataFrame:
    return params.df if isinstance(params, Sized) else params
