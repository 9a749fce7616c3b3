"""Curriculum analytics over very large sample tables, on Spark DataFrames."""

from lehrplan.registry import DATASETS, METRICS, RANKS, SCHEDULES

__all__ = ["DATASETS", "METRICS", "RANKS", "SCHEDULES"]
