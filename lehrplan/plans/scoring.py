"""Score a corpus: images and training histories -> score table, only where scores are missing."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

import lehrplan.operators.history  # noqa: F401  (registers its metrics)
from lehrplan.functions.columns import named
from lehrplan.operators.image_kernels import image_metric_ids, score_images
from lehrplan.registry import METRICS
from lehrplan.sources.reports import sample_report
from lehrplan.sources.scores import (last_version, load_scores, partition, save_changes, save_scores,
                                     with_metrics)
from lehrplan.sources.staging import stage

log = logging.getLogger("lehrplan")


def requested_metrics(requested: Sequence[str], inputs: Sequence[str] = ("images",)) -> list[str]:
    """Known metrics among the requested ids (``all`` = every one) that the given kinds of input
    allow; others are reported and dropped."""
    allowed = [m for m in METRICS.ids() if METRICS.get(m).config.get("input") in inputs]
    if list(requested) == ["all"]:
        return allowed
    known, unknown = METRICS.split(requested)
    if unknown:
        log.warning("unknown metrics ignored: %s", ", ".join(unknown))
    if others := [m for m in known if m not in allowed]:
        log.warning("metrics that %s alone do not give ignored: %s", " and ".join(inputs),
                    ", ".join(others))
    return [m for m in known if m in allowed]


def missing_metrics(images: DataFrame, scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """``index, wanted``: samples that lack some of the metrics, or are not in the table."""
    lacking = F.array_compact(F.array(*[F.when(named(m).isNull(), F.lit(m)) for m in metrics]))
    known = with_metrics(scores, metrics).select(
        "index", lacking.cast("array<string>").alias("wanted"))
    everything = F.array(*[F.lit(m) for m in metrics]).cast("array<string>")
    new = F.col("wanted").isNull()
    return (images.select("index").distinct().join(known, "index", "left")
            .where(new | (F.size("wanted") > 0))
            .select("index", F.coalesce("wanted", everything).alias("wanted")))


def score_wanted(images: DataFrame, metrics: Sequence[str], options: dict | None = None,
                 histories: dict[str, DataFrame] | None = None, ids: DataFrame | None = None
                 ) -> DataFrame:
    """``index, class, <metric> double..., errors map`` of all samples, or of ``ids(index,
    wanted)`` with the wanted metrics only. ``histories`` holds the tables ``history`` and
    ``layer_history`` for the metrics that read them."""
    rows = images if ids is None else images.select(
        "index", "class", "c", "h", "w", "data").join(ids, "index")
    pictures = [m for m in metrics if m in image_metric_ids()]
    scored = score_images(rows, pictures, options, None if ids is None else "wanted") \
        if pictures else rows.select("index", F.col("class").cast("string").alias("class"),
                                     F.create_map().cast("map<string,string>").alias("errors"))
    for m in metrics:
        if m not in pictures:
            series = histories[METRICS.get(m).config["input"]]
            if ids is not None:
                series = series.join(ids.where(F.array_contains("wanted", m)), "index",
                                     "left_semi")
            found = METRICS.get(m).build(series, **(options or {}).get(m, {}))
            scored = scored.join(found.select("index", F.col("value").alias(m)), "index", "left")
    return scored.select("index", "class", *[named(m) for m in metrics], "errors")


def score_dataset(spark: SparkSession, images: DataFrame, path: str, dataset: str,
                  seed: int = 1, metrics: Sequence[str] = ("all",),
                  options: dict | None = None, history: DataFrame | None = None,
                  layer_history: DataFrame | None = None) -> DataFrame:
    """Resume or start the stored score table of a corpus and return it.

    A sample's stored scores are not computed again; nothing is written when none is missing, and
    else only what is new. What failed is stored with its error text (`load_errors`), its score
    stays missing and is tried again by the next call.
    """
    histories = {name: table for name, table in (("history", history),
                                                 ("layer_history", layer_history))
                 if table is not None}
    metrics = requested_metrics(metrics, ["images", *histories])
    if not last_version(spark, partition(path, dataset, seed)):
        # nothing scored yet: one map over the images
        found = stage(score_wanted(images, metrics, options, histories), "scored")
        save_scores(with_metrics(found.drop("errors"), metrics), path, dataset, seed, failures(found))
        return load_scores(spark, path, dataset, seed)
    scores = load_scores(spark, path, dataset, seed)
    # ids first: while few samples are left, the images are filtered without being moved
    ids = stage(missing_metrics(images, scores, metrics), "pending")
    if ids.isEmpty():
        return with_metrics(scores, metrics)
    found = stage(score_wanted(images, metrics, options, histories, ids), "scored")
    tried = ids.select("index", F.explode("wanted").alias("metric")).join(
        failures(found), ["index", "metric"], "left")
    save_changes(found.drop("errors"), path, dataset, seed, tried.select("index", "metric", "error"))
    return load_scores(spark, path, dataset, seed)


def failures(scored: DataFrame) -> DataFrame:
    return scored.select("index", F.explode("errors").alias("metric", "error"))


def score_sample(images: DataFrame, index: int, metrics: Sequence[str] = ("all",),
                 options: dict | None = None) -> DataFrame:
    """``index, report``: JSON of one sample's metrics; a failed metric holds its error text."""
    metrics = requested_metrics(metrics)
    scored = score_images(images.where(F.col("index") == index), metrics, options)
    return sample_report(scored, metrics, errors="errors")
