"""Analyse scores: score table -> distribution files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lehrplan.operators.distributions import distributions
from lehrplan.sources.reports import write_distributions


def analyze_scores(scores: DataFrame, path: str, metrics: Sequence[str] | None = None
                   ) -> DataFrame:
    table = distributions(scores, metrics)
    write_distributions(table, path)
    return table
