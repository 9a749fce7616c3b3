"""Incremental scoring: new images are scored as they arrive.

Indices met before are the state of the stream, looked up one by one in a store on the executors,
so a micro-batch reads nothing of the log and costs the same however long that is. Each micro-batch
appends one part to the score log. The part is named after the micro-batch, so a replayed
micro-batch replaces its own part instead of adding rows twice. A sample whose metrics fail is
logged with its errors and not tried again; a log holds one row per index and one set of metrics.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from lehrplan.operators.image_kernels import score_images
from lehrplan.plans.scoring import requested_metrics
from lehrplan.sources.scores import schema
from lehrplan.streaming.sessions import ROCKSDB, held


def read_log(spark: SparkSession, path: str, metrics: Sequence[str],
             errors: bool = False) -> DataFrame:
    """Scores logged so far (empty before the first part); ``errors`` adds the map from failed
    metrics to their error texts."""
    fields = schema(metrics)
    if errors:
        fields = fields.add("errors", T.MapType(T.StringType(), T.StringType()))
    fields = fields.add("part", "long")
    try:
        log = spark.read.schema(fields).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], fields)
    return log.drop("part")


def score_stream(images: DataFrame, path: str, checkpoint: str,
                 metrics: Sequence[str] = ("all",), options: dict | None = None,
                 trigger: dict | None = None, partitions: int | None = None) -> StreamingQuery:
    """Score every sample of the stream once.

    The first image of an index counts, and one of them where a micro-batch brings several; later
    ones are skipped. What has been met is known to the checkpoint, which belongs to its log.
    ``trigger`` holds the arguments of ``DataStreamWriter.trigger``; by default the stream ends when
    all that is there has been read. ``partitions`` sets the number of state partitions, which stays
    for the life of the checkpoint.

    Raises if the log lacks a requested metric: score another set into a log of its own.
    """
    metrics = requested_metrics(metrics)
    spark = images.sparkSession
    try:
        logged = spark.read.parquet(path).columns
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        logged = metrics
    if lacking := [m for m in metrics if m not in logged]:
        raise ValueError(f"the log lacks {', '.join(lacking)}")

    def step(batch: DataFrame, batch_id: int) -> None:
        score_images(batch, metrics, options).write.mode("overwrite").parquet(f"{path}/part={batch_id}")

    with held(spark, ROCKSDB, partitions):
        return (images.dropDuplicates(["index"]).writeStream.foreachBatch(step)
                .option("checkpointLocation", checkpoint)
                .trigger(**trigger or {"availableNow": True}).start())
