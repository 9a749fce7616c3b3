"""Session settings the operators expect.

On a cluster these belong in the submit configuration; ``local_session`` is what
the tests and the bench use.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # image rows are wide: bound an Arrow batch by rows as well as by Spark's byte limit
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
}


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  memory: str = "8g") -> SparkSession:
    parts = shuffle_partitions or (cores if isinstance(cores, int) else 8)
    builder = (SparkSession.builder.master(f"local[{cores}]").appName("lehrplan")
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", memory)
               .config("spark.sql.shuffle.partitions", str(parts)))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
