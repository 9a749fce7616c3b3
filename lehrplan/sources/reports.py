"""Sinks for results: distribution files, run records, sample reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lehrplan.functions.columns import named
from lehrplan.operators.runs import append_rows
from lehrplan.sources.commits import read_known


def write_distributions(table: DataFrame, path: str) -> None:
    """CSV with one folder per metric."""
    (table.repartition("metric").write.mode("overwrite").partitionBy("metric")
     .option("header", "true").csv(path))


def read_distributions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Statistics written by `write_distributions`; the metric comes from the folder."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)


def append_runs(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Append run records that are not in the table yet (the first call creates it). Two writers
    at once may both append a run; `load_runs` reads it once."""
    known = read_known(spark, path, rows.schema)
    append_rows(rows, known).write.mode("append").parquet(path)


def load_runs(spark: SparkSession, path: str) -> DataFrame:
    """The recorded runs, one row per hash: of several the least by its other columns."""
    table = spark.read.parquet(path)
    rest = F.struct(*[named(c) for c in table.columns])
    return table.groupBy("hash").agg(F.min(rest).alias("_row")).select("_row.*")


def write_documents(documents: DataFrame, path: str) -> None:
    documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def sample_report(scores: DataFrame, metrics: Sequence[str], errors: str | None = None
                  ) -> DataFrame:
    """``index, report``: JSON map of metric to number; with the name of an ``errors`` map
    column, a failed metric holds its error text."""
    def entry(metric: str) -> Column:
        values = [named(metric).cast("string")]
        if errors:
            text = F.to_json(F.array(F.try_element_at(errors, F.lit(metric))))  # ["..."]
            values.append(F.when(F.try_element_at(errors, F.lit(metric)).isNotNull(),
                                 F.substring(text, F.lit(2), F.length(text) - 2)))
        return F.concat(F.lit(f'"{metric}":'), F.coalesce(*values, F.lit("null")))

    return scores.select("index", F.concat(
        F.lit("{"), F.concat_ws(",", *[entry(m) for m in metrics]), F.lit("}")).alias("report"))
