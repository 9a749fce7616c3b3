"""Feed a training job: scores -> curriculum -> paced sample order, and telemetry -> records."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from lehrplan.operators import curriculum as C, runs as R, schedules as S
from lehrplan.registry import SCHEDULES
from lehrplan.sources.reports import append_runs, load_runs
from lehrplan.sources.staging import stage


@dataclass(frozen=True)
class Settings:
    """Curriculum settings of a run; ``metric=None`` is a baseline without curriculum."""
    dataset: str
    epochs: int
    batch_size: int = 128
    shuffle: bool = False
    metric: str | tuple[str, ...] | None = None
    rank: str = "ascending"
    scope: str = "holistic"
    schedule: str | None = None
    start_fraction: float = 0.3
    normalize_classes: bool = False
    seed: int = 1
    run: str | None = None

    def row(self, spark: SparkSession) -> DataFrame:
        fields = asdict(self)
        del fields["run"]
        metric = fields["metric"]
        fields["metric"] = ",".join(metric) if isinstance(metric, tuple) else metric
        return spark.range(1).select(*[F.lit(v).alias(k) for k, v in fields.items()])


def batches(scores: DataFrame, settings: Settings) -> DataFrame:
    """Training batches of a run, with or without a curriculum."""
    if settings.metric is None:
        return C.baseline(scores, settings.batch_size,
                          settings.seed if settings.shuffle else None)
    metric = list(settings.metric) if isinstance(settings.metric, tuple) else settings.metric
    cut = C.curriculum(scores, settings.rank, metric, settings.batch_size, settings.scope,
                       settings.seed)
    if not settings.normalize_classes:
        return cut
    place = (F.col("batch_idx").cast("long") * settings.batch_size + F.col("pos_in_batch"))
    labelled = cut.select("index", place.alias("position")).join(
        scores.select("index", "class"), "index")
    return C.class_balanced(labelled, settings.batch_size)


def paced_samples(scores: DataFrame, settings: Settings, epochs: DataFrame | None = None,
                  signals: DataFrame | None = None) -> DataFrame:
    """``epoch, position, index``: the samples of every epoch in the order to train on them.

    ``epochs`` and ``signals`` are the telemetry of one run; adaptive schedules need it. Its name is
    ``settings.run`` or that of the only run in the telemetry. Raises if the telemetry holds no such
    run, or several and none is named; and on a schedule that leaves an epoch without batches.
    """
    cut = stage(batches(scores, settings), "batches")
    entry = SCHEDULES.get(settings.schedule) if settings.metric and settings.schedule else None
    name = settings.run or "run"
    if entry is not None and "adaptive" in entry.tags:
        name = run_of([t for t in (epochs, signals) if t is not None], settings.run)
    runs = cut.agg((F.max("batch_idx") + 1).alias("total_batches")).select(
        F.lit(name).alias("run"), "total_batches")
    if entry is None:
        counts = runs.select(F.explode(F.sequence(F.lit(1), F.lit(settings.epochs)))
                             .alias("epoch"), F.col("total_batches").alias("n_active"))
        return C.prefix_sequence(counts, cut, settings.batch_size)
    order = entry.build(runs, settings.epochs, epochs=epochs, signals=signals,
                        start_fraction=settings.start_fraction)
    if "prefix" in entry.tags:
        counts = stage(S.exposure_counts(order, runs, settings.epochs), "counts")
        check_epochs(counts, settings.epochs)
        return C.prefix_sequence(counts, cut, settings.batch_size)
    shown = stage(S.exposure(order, runs, settings.epochs).drop("run"), "exposed")
    check_epochs(shown.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_active")), settings.epochs)
    return C.permuted_sequence(shown, cut, settings.batch_size)


def run_of(telemetry: list[DataFrame], name: str | None) -> str:
    """The run that tables of telemetry report on."""
    if not telemetry:
        raise ValueError("this schedule needs telemetry: epochs, signals or both")
    for table in telemetry:
        found = [r["run"] for r in table.select("run").distinct().limit(3).collect()]
        if name is not None and not table.where(F.col("run") == name).isEmpty():
            continue
        if name is not None or len(found) != 1:
            raise ValueError(f"the telemetry has no run '{name}'" if name is not None else
                             f"name the run: the telemetry has {'several' if found else 'none'}")
        name = found[0]
    return name


def check_epochs(counts: DataFrame, epochs: int) -> None:
    """Every epoch from 1 on exposes batches; one row for each epoch is read."""
    shown = {r["epoch"] for r in counts.where("n_active > 0").select("epoch").distinct().collect()}
    lacking = sorted(set(range(1, epochs + 1)) - shown)
    if lacking:
        raise ValueError(f"the schedule exposes nothing in epochs {lacking[:10]}"
                         f"{' and more' if len(lacking) > 10 else ''}: is telemetry missing?")


def record_runs(spark: SparkSession, epochs: DataFrame, configs: DataFrame, path: str
                ) -> DataFrame:
    """Append the records of finished runs that are not recorded yet; return the table."""
    append_runs(spark, R.run_rows(epochs, configs), path)
    return load_runs(spark, path)
