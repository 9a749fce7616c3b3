"""Cache of computed rankings, one folder per entry and a log of those written to their end.

The key covers everything that determines a ranking, including a fingerprint of the scores,
so a changed table or another scope never meets a stale entry.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lehrplan.functions.columns import named, present
from lehrplan.operators.ranks import rank
from lehrplan.registry import METRICS
from lehrplan.sources.commits import publish, records, write_new


def fingerprint(scores: DataFrame, metrics: Sequence[str], index: str = "index") -> Column:
    """Order-free digest of the ranked columns, as a scalar subquery."""
    numbers = {f.name for f in scores.schema.fields
               if f.dataType.typeName() in ("double", "float")}
    row = F.xxhash64(named(index), *[present(named(m)) if m in numbers else named(m)
                                     for m in metrics])
    digest = scores.agg(F.format_string(
        "%d-%s", F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")).cast("string")).alias("f"))
    return digest.scalar()


def cache_key(scheme: str, dataset: str, metrics: Sequence[str], seed: int, scope: str,
              batch_size: int, version: Column, options: dict | None = None) -> Column:
    return F.md5(F.to_json(F.struct(
        F.lit(batch_size).alias("batch_size"), F.lit(dataset).alias("dataset"),
        F.array(*[F.lit(m) for m in metrics]).alias("metric"), F.lit(scheme).alias("rank"),
        F.lit(json.dumps(options or {}, sort_keys=True, default=str)).alias("options"),
        F.lit(scope).alias("scope"), F.lit(seed).alias("seed"), version.alias("version"))))


ENTRY = "version long, id string, rank_key string, ranking string"


def entry(spark: SparkSession, path: str, key: str) -> str | None:
    """Folder of a published ranking."""
    row = records(spark, path, ENTRY).where(F.col("rank_key") == key).orderBy("id").first()
    return f"{path}/{row['ranking']}" if row else None


def cached_rank(spark: SparkSession, path: str, scores: DataFrame, scheme: str,
                metrics: str | Sequence[str], dataset: str, seed: int = 1,
                scope: str = "holistic", batch_size: int = 128, version: str | None = None,
                **options) -> DataFrame:
    """Ranking from the cache, computed and stored on a miss.

    The fingerprint covers every column: schemes read others than the ranked ones (weights, the
    class, the row order). All options are part of the key, left out or given by name. Stored
    scores have a fingerprint already: with their ``scores_version`` as ``version`` they are not
    read on a hit.

    An entry is published when it is whole. What a crash left behind is never read, and two
    writers of one key leave two equal rankings, of which all read the same.
    """
    metrics = [metrics] if isinstance(metrics, str) else list(metrics)
    if options.get("inverted") is None:
        options = {**options, "inverted": sorted(METRICS.ids(["inverted"]))}
    digest = F.lit(version) if version else fingerprint(scores, sorted(scores.columns))
    key = spark.range(1).select(cache_key(
        scheme, dataset, metrics, seed, scope, batch_size, digest, options).alias("k")).first()["k"]
    found = entry(spark, path, key)
    if found is None:
        ranking = write_new(rank(scores, scheme, metrics, **options), path, "ranking")
        publish(spark, path, ENTRY, version=1, id=ranking, rank_key=key, ranking=ranking)
        found = entry(spark, path, key)
    return spark.read.parquet(found)
