"""Folders that become visible whole.

Data go to a folder of their own first. A record that names them is written last, as one small
file which Spark's output commit puts in place by one rename: a reader sees the record or does not,
whatever was written before a crash. Nothing rests on ``_SUCCESS`` files or on a lister's view of the
data folders, and only the public reader and writer are used, so any store of Spark's serves.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_known(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A table of a known schema, empty while its folder does not exist."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_new(table: DataFrame, folder: str, label: str) -> str:
    """Write a table below a folder; its name, which no other write has."""
    name = f"{label}-{uuid.uuid4().hex}"
    table.write.parquet(f"{folder}/{name}")
    return name


def publish(spark: SparkSession, folder: str, schema: str, **record) -> None:
    """Add one record to the log of a folder."""
    fields = T.StructType.fromDDL(schema)
    row = [record[f.name] for f in fields]
    spark.createDataFrame([row], fields).coalesce(1).write.mode("append").parquet(f"{folder}/log")


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return read_known(spark, f"{folder}/log", schema)


def last_record(spark: SparkSession, folder: str, schema: str) -> dict | None:
    """The record with the highest version; of two with the same one, that of the least id."""
    row = records(spark, folder, schema).orderBy(F.col("version").desc(), "id").first()
    return row.asDict() if row else None


def publish_next(spark: SparkSession, folder: str, schema: str, before: dict | None, **record) -> None:
    """Add the record that follows ``before``. Raises if another writer did so first: what it
    wrote stays, and this write stays invisible."""
    version, own = (before["version"] if before else 0) + 1, uuid.uuid4().hex
    publish(spark, folder, schema, version=version, id=own, **record)
    if last_record(spark, folder, schema)["id"] != own:
        raise RuntimeError(f"another writer saved version {version} of {folder}")
