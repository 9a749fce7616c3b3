"""The score table: ``index, class`` and one nullable double per metric.

A stored partition is a whole table and tables of changes, named by the record of its last version;
a reader merges them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lehrplan.functions.columns import metric_columns, named, present
from lehrplan.registry import METRICS
from lehrplan.sources.commits import last_record, publish_next, write_new

META = ("index", "class")


def schema(metrics: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField("index", T.LongType(), False),
                         T.StructField("class", T.StringType()),
                         *[T.StructField(m, T.DoubleType()) for m in metrics]])


def init_scores(samples: DataFrame | int, metrics: Sequence[str] | None = None,
                spark: SparkSession | None = None, index: str = "index") -> DataFrame:
    """Unscored table for samples 0..n-1 (a number) or for the ids of a sample table."""
    ids = spark.range(samples).toDF("index") if isinstance(samples, int) \
        else samples.select(named(index).cast("long").alias("index"))
    metrics = METRICS.ids() if metrics is None else metrics
    return ids.select("index", F.lit(None).cast("string").alias("class"),
                      *[F.lit(None).cast("double").alias(m) for m in metrics])


def with_metrics(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Add missing metric columns as unscored and turn NaN into missing."""
    have = set(scores.columns)
    return scores.select(
        *[named(m) for m in META],
        *[(present(named(m)) if m in have else F.lit(None).cast("double")).alias(m)
          for m in dict.fromkeys([*metric_columns(scores, META), *metrics])])


def select_metrics(scores: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Requested metric columns; ids the table lacks are dropped."""
    known = metric_columns(scores, META) if list(requested) == ["all"] else \
        [m for m in requested if m in metric_columns(scores, META)]
    return scores.select(*[named(c) for c in [*META, *known]])


def partition(path: str, dataset: str, seed: int) -> str:
    """Folder of one (dataset, seed) partition."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", dataset):
        raise ValueError(f"dataset id '{dataset}' would be escaped in a path")
    return f"{path}/dataset={dataset}/seed={seed}"


# A version of a partition: the folders of its whole tables and of the changes since, oldest first.
VERSION = ("version long, id string, scores string, changes array<string>, errors string, "
           "error_changes array<string>")
ERRORS = "index long, metric string, error string"
MOST_CHANGES = 8  # tables of changes before a save writes the whole table anew


def last_version(spark: SparkSession, folder: str) -> int:
    """Number of the last version of a partition; 0 if there is none."""
    record = last_record(spark, folder, VERSION)
    return record["version"] if record else 0


def save_scores(scores: DataFrame, path: str, dataset: str, seed: int,
                errors: DataFrame | None = None) -> str:
    """Replace one (dataset, seed) partition; other partitions are untouched.

    Scores and errors (``index, metric, error``) become visible together. ``scores`` may read the
    version before, which stays until it is expired.
    """
    target, spark = partition(path, dataset, seed), scores.sparkSession
    publish_next(spark, target, VERSION, last_record(spark, target, VERSION),
                 scores=write_new(scores, target, "scores"), changes=[],
                 errors=None if errors is None else write_new(errors, target, "errors"), error_changes=[])
    return target


def save_changes(changed: DataFrame, path: str, dataset: str, seed: int,
                 errors: DataFrame | None = None) -> str:
    """Add scores and errors of some samples to a stored partition, as tables of their own.

    New scores count over old ones; a missing new score erases none, and metrics ``changed`` lacks
    stay. ``errors`` has a row for everything tried: a missing ``error`` clears an older one. Many
    tables of changes are merged into a whole one.
    """
    target, spark = partition(path, dataset, seed), changed.sparkSession
    record = last_record(spark, target, VERSION)
    if record is None:
        found = None if errors is None else errors.where("error is not null")
        return save_scores(changed, path, dataset, seed, found)
    new = dict(record, changes=[*record["changes"], write_new(changed, target, "changes")])
    if errors is not None:
        new["error_changes"] = [*record["error_changes"], write_new(errors, target, "error-changes")]
    if len(new["changes"]) >= MOST_CHANGES:
        return save_scores(_scores(spark, target, new), path, dataset, seed, _errors(spark, target, new))
    publish_next(spark, target, VERSION, record, **{k: v for k, v in new.items()
                                                    if k not in ("version", "id")})
    return target


def compact(spark: SparkSession, path: str, dataset: str, seed: int) -> str:
    """Write a partition and its changes as whole tables."""
    target = partition(path, dataset, seed)
    record = last_record(spark, target, VERSION)
    return save_scores(_scores(spark, target, record), path, dataset, seed, _errors(spark, target, record))


def _scores(spark: SparkSession, target: str, record: dict) -> DataFrame:
    scores = spark.read.parquet(f"{target}/{record['scores']}")
    if not record["changes"]:
        return scores
    parts = [spark.read.parquet(f"{target}/{name}").withColumn("_turn", F.lit(i))
             for i, name in enumerate(record["changes"])]
    changes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rest = [c for c in changes.columns if c not in ("index", "_turn")]
    # the newest value of each column; the changes are few, so the whole table need not move
    newest = changes.groupBy("index").agg(*[F.max_by(named(c), F.when(named(c).isNotNull(), F.col("_turn")))
                                            .alias(c) for c in rest])
    return upsert_few(scores, newest)


def upsert_few(scores: DataFrame, new: DataFrame) -> DataFrame:
    """`upsert` for few new rows: the old table is filtered and looked up, and joined in place
    where the planner can broadcast the new one."""
    metrics = list(dict.fromkeys([*metric_columns(scores, META), *metric_columns(new, META)]))
    fresh = with_metrics(new, metrics)
    fresh = fresh.select(*[named(c).alias(f"_new_{c}") for c in fresh.columns])
    old = with_metrics(scores, metrics)
    match = F.col("index") == F.col("_new_index")
    kept = old.join(fresh, match, "left").select(
        "index", *[F.coalesce(named(f"_new_{c}"), named(c)).alias(c) for c in ("class", *metrics)])
    added = fresh.join(old.select("index"), match, "left_anti")
    return kept.unionByName(added.toDF(*["index", "class", *metrics]))


def _errors(spark: SparkSession, target: str, record: dict) -> DataFrame:
    names = [n for n in (record["errors"], *record["error_changes"]) if n]
    if not names:
        return spark.createDataFrame([], ERRORS)
    rows = reduce(DataFrame.unionByName, [
        spark.read.schema(ERRORS).parquet(f"{target}/{name}").withColumn("_turn", F.lit(i))
        for i, name in enumerate(names)])
    last = rows.groupBy("index", "metric").agg(F.max_by(F.struct("error"), "_turn").alias("_last"))
    return last.select("index", "metric", F.col("_last.error").alias("error")).where("error is not null")


def load_scores(spark: SparkSession, path: str, dataset: str, seed: int) -> DataFrame:
    """One partition of the table, with its own metric columns; no other folder is listed."""
    target = partition(path, dataset, seed)
    record = last_record(spark, target, VERSION)
    if record is None:
        raise FileNotFoundError(f"no scores saved in {target}")
    return _scores(spark, target, record)


def load_errors(spark: SparkSession, path: str, dataset: str, seed: int) -> DataFrame:
    """``index, metric, error`` of what failed so far (empty before the first run)."""
    target = partition(path, dataset, seed)
    record = last_record(spark, target, VERSION)
    return _errors(spark, target, record) if record else spark.createDataFrame([], ERRORS)


def scores_version(spark: SparkSession, path: str, dataset: str, seed: int) -> str:
    """Names of the tables a stored partition consists of: never used again for others, so equal
    names mean equal scores."""
    record = last_record(spark, partition(path, dataset, seed), VERSION)
    if record is None:
        raise FileNotFoundError(f"no scores saved in {partition(path, dataset, seed)}")
    return ",".join([record["scores"], *record["changes"]])


def read_scores_csv(spark: SparkSession, path: str, metrics: Sequence[str]) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema(metrics), enforceSchema=False,
                          nullValue="", nanValue="NaN")


def get_score(scores: DataFrame, index: int, metric: str) -> DataFrame:
    """The one-row score of a sample. Unknown metrics raise here, unknown samples on use."""
    if metric not in metric_columns(scores, META):
        raise KeyError(f"metric not defined: {metric}")
    return scores.where(F.col("index") == index).select("index", named(metric).alias("score"))


def score_value(scores: DataFrame, index: int, metric: str) -> float | None:
    row = get_score(scores, index, metric).first()
    if row is None:
        raise IndexError(f"no score found for index {index}")
    return row["score"]


def unscored(scores: DataFrame, metric: str) -> DataFrame:
    """Indices a metric still has to score; all of them if the column is absent."""
    if metric not in scores.columns:
        return scores.select("index")
    return scores.where(present(named(metric)).isNull()).select("index")


def pending(samples: DataFrame, scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Samples that lack at least one of the metrics."""
    complete = with_metrics(scores, metrics)
    for m in metrics:
        complete = complete.where(named(m).isNotNull())
    return samples.join(complete.select("index"), "index", "left_anti")


def upsert(scores: DataFrame, new: DataFrame) -> DataFrame:
    """Write new scores over old ones by index; metrics ``new`` lacks keep their value, and a
    missing new score never erases an old one."""
    metrics = list(dict.fromkeys([*metric_columns(scores, META), *metric_columns(new, META)]))
    old = with_metrics(scores, metrics)
    fresh = with_metrics(new, metrics)
    fresh = fresh.select(*[named(c).alias(f"_new_{c}") for c in fresh.columns])
    joined = old.join(fresh, F.col("index") == F.col("_new_index"), "full_outer")
    return joined.select(*[F.coalesce(named(f"_new_{c}"), named(c)).alias(c)
                           for c in [*META, *metrics]])


def label_names(samples: DataFrame, names: DataFrame, label: str = "label") -> DataFrame:
    """Attach the class name of each label id (``names(label, class)``)."""
    return samples.join(names, label, "left")
