"""Expressions on arrays of class logits, computed in double with the maximum shifted out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lehrplan.functions.columns import let


def shifted(logits: Column) -> Column:
    return let(F.array_max(logits).cast("double"), lambda top: F.transform(
        logits, lambda x: x.cast("double") - top))


def log_sum_exp(logits: Column) -> Column:
    """log(sum(exp)) of already shifted logits."""
    return F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x)))


def cross_entropy(logits: Column, target: Column) -> Column:
    return let(shifted(logits), lambda z: log_sum_exp(z) - F.get(z, target))


def softmax_entropy(logits: Column, floor: float = -1e9) -> Column:
    """-sum(p log p) with log p clamped from below."""
    return let(shifted(logits), lambda z: let(log_sum_exp(z), lambda norm: -F.aggregate(
        z, F.lit(0.0),
        lambda s, x: s + F.exp(x - norm) * F.greatest(x - norm, F.lit(floor)))))


def predicted(logits: Column) -> Column:
    """Position of the largest logit, the first on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
