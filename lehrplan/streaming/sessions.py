"""Settings a stateful stream keeps from its start."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def held(spark: SparkSession, provider: str, partitions: int | None = None) -> Iterator[None]:
    """Start a stream inside: it keeps this state store and number of state partitions, and the
    session gets its own settings back."""
    settings = {"spark.sql.streaming.stateStore.providerClass": provider}
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
