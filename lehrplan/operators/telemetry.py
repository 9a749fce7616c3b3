"""Per-batch and per-epoch training telemetry from logged outputs.

Every table is keyed by the true batch index, never by the position in an epoch's loop.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lehrplan.functions.columns import ratio
from lehrplan.functions.logits import cross_entropy, predicted, softmax_entropy

BATCH = ["run", "epoch", "batch_idx"]


def sample_outcomes(logits: DataFrame) -> DataFrame:
    """Cross-entropy, prediction, correctness and softmax entropy of each sample."""
    return logits.select(
        "index", *BATCH, cross_entropy(F.col("logits"), F.col("target")).alias("cross_entropy"),
        predicted(F.col("logits")).alias("predicted"),
        (predicted(F.col("logits")) == F.col("target")).alias("correct"),
        softmax_entropy(F.col("logits")).alias("entropy"))


def batch_entropy(logits: DataFrame) -> DataFrame:
    return logits.select(*BATCH, softmax_entropy(F.col("logits")).alias("e")).groupBy(
        *BATCH).agg(F.avg("e").alias("mean_entropy"))


def batch_activation_std(activations: DataFrame) -> DataFrame:
    """Mean over layers of the deviation (N-1) of a batch's activations."""
    layers = activations.groupBy(*BATCH, "layer").agg(F.stddev_samp("value").alias("s"))
    return layers.groupBy(*BATCH).agg(F.avg("s").alias("mean_std"))


def batch_grad_norm(gradients: DataFrame) -> DataFrame:
    """Mean over parameters of the L2 norm of the gradient; 0.0 without any gradient."""
    norms = gradients.groupBy(*BATCH, "layer").agg(
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    return norms.groupBy(*BATCH).agg(F.coalesce(F.avg("n"), F.lit(0.0))
                                     .alias("mean_grad_norm"))


def epoch_metrics(logits: DataFrame) -> DataFrame:
    """Accuracy over samples and loss as the mean of batch means, both to 4 decimals."""
    outcomes = logits.select(*BATCH, cross_entropy(F.col("logits"), F.col("target")).alias("ce"),
                             (predicted(F.col("logits")) == F.col("target")).cast("long")
                             .alias("hit"))
    batches = outcomes.groupBy(*BATCH).agg(
        F.avg("ce").alias("loss"), F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    return batches.groupBy("run", "epoch").agg(
        F.round(ratio(F.sum("hits").cast("double"), F.sum("n").cast("double")), 4)
        .alias("accuracy"),
        F.round(F.avg("loss"), 4).alias("loss"),
        F.count(F.lit(1)).cast("int").alias("batches"))


def signal_frame(*parts: DataFrame) -> DataFrame:
    """Batch signals side by side, one row per (run, epoch, batch)."""
    return reduce(lambda a, b: a.join(b, BATCH, "full_outer"), parts)


def batch_signals(values: DataFrame) -> DataFrame:
    """All three batch signals from one scan of logged numbers: ``run, epoch, batch_idx, mean_std,
    mean_grad_norm, mean_entropy``.

    ``values`` holds ``layer`` and any of ``activation`` and ``gradient`` per element, and
    ``entropy`` per sample (its rows need no layer); numbers that a row lacks are missing. A signal
    of which a batch logged nothing is missing, the gradient norm 0.0. Sums are combined before both
    shuffles, first by layer, then by batch.
    """
    logged = set(values.columns)
    number = {n: F.col(n).cast("double") if n in logged else F.lit(None).cast("double")
              for n in ("activation", "gradient", "entropy")}
    layers = values.select(*BATCH, "layer", *[c.alias(n) for n, c in number.items()]).groupBy(
        *BATCH, "layer").agg(
        F.stddev_samp("activation").alias("_std"),
        F.sqrt(F.sum(F.col("gradient") * F.col("gradient"))).alias("_norm"),
        F.sum("entropy").alias("_entropy"), F.count("entropy").cast("double").alias("_samples"))
    return layers.groupBy(*BATCH).agg(
        F.avg("_std").alias("mean_std"), F.coalesce(F.avg("_norm"), F.lit(0.0)).alias("mean_grad_norm"),
        ratio(F.sum("_entropy"), F.sum("_samples")).alias("mean_entropy"))
