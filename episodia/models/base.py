"""What every scorer offers: fit on training rows, then score and explain any rows, one result per row."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame


class AnomalyModel(Protocol):
    contributors: list[str]

    def fit(self, train: DataFrame) -> AnomalyModel: ...

    def score(self, rows: DataFrame) -> DataFrame:
        """rows plus `score`, higher is more anomalous."""

    def contributions(self, rows: DataFrame) -> DataFrame:
        """rows plus one column per contributor."""
