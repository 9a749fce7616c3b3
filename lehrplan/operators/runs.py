"""Run records: summaries of epoch telemetry, hashes, comparison and the experiment grid.

``epochs(run, epoch, train_acc, train_loss, val_acc, val_loss, batches)`` is the flat form of an
epoch record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lehrplan.functions.columns import ratio

RUN_FIELDS = ["network_id", "dataset_id", "epochs", "seed", "device", "final_accuracy",
              "final_loss", "best_accuracy", "best_loss", "best_epoch", "shuffled",
              "normalize_classes", "rank", "metric", "scope", "schedule", "start_fraction",
              "dsi", "max_batches_per_epoch", "total_batches_processed", "record_file", "hash"]


def upsert_epochs(records: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Latest record of each (run, epoch): recording an epoch again replaces it."""
    rest = [c for c in records.columns if c not in ("run", "epoch", arrival)]
    latest = F.max_by(F.struct(*rest), F.col(arrival)).alias("r")
    return records.groupBy("run", "epoch").agg(latest).select("run", "epoch", "r.*")


def nest_epochs(epochs: DataFrame) -> DataFrame:
    """The nested form: train and validation structs and the batch count."""
    return epochs.select(
        "run", "epoch",
        F.struct(F.col("train_acc").alias("accuracy"), F.col("train_loss").alias("loss"))
        .alias("train"),
        F.struct(F.col("val_acc").alias("accuracy"), F.col("val_loss").alias("loss"))
        .alias("validation"), "batches")


def saturation_index(processed: Column, max_batches: Column, epochs: Column) -> Column:
    """Share of the data a run did not use; missing without counts or a reference."""
    return F.round(1.0 - ratio(processed.cast("double"),
                               max_batches.cast("double") * epochs.cast("double")), 4)


def _best() -> Column:
    # first epoch on ties
    return F.max_by(F.struct("epoch", "val_acc", "val_loss"),
                    F.struct(F.col("val_acc"), -F.col("epoch"))).alias("best")


def _final() -> Column:
    return F.max_by(F.struct("train_acc", "train_loss", "val_acc", "val_loss"),
                    F.col("epoch")).alias("final")


def best_epoch(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("run").agg(_best()).select(
        "run", F.col("best.epoch").alias("best_epoch"),
        F.col("best.val_acc").alias("best_accuracy"), F.col("best.val_loss").alias("best_loss"))


def final_values(epochs: DataFrame) -> DataFrame:
    return epochs.groupBy("run").agg(_final()).select(
        "run", F.col("final.train_acc").alias("final_train_accuracy"),
        F.col("final.train_loss").alias("final_train_loss"),
        F.col("final.val_acc").alias("final_val_accuracy"),
        F.col("final.val_loss").alias("final_val_loss"))


def dsi(epochs: DataFrame, settings: DataFrame) -> DataFrame:
    """``settings(run, max_batches, num_epochs)``."""
    used = epochs.groupBy("run").agg(F.sum("batches").alias("_used"))
    return used.join(settings, "run").select(
        "run", saturation_index(F.col("_used"), F.col("max_batches"), F.col("num_epochs"))
        .alias("dsi"))


def series(epochs: DataFrame) -> DataFrame:
    """Per run: total batches, batches per epoch and the four metric series in epoch order."""
    rows = epochs.groupBy("run").agg(
        F.sum("batches").cast("long").alias("total_batches_processed"),
        F.array_sort(F.collect_list(F.struct(
            "epoch", "batches", "train_acc", "train_loss", "val_acc", "val_loss"))).alias("s"))
    pick = lambda field: F.transform("s", lambda e: e[field])
    return rows.select(
        "run", "total_batches_processed", pick("batches").alias("batches_per_epoch"),
        pick("train_acc").alias("train_accuracies"), pick("train_loss").alias("train_losses"),
        pick("val_acc").alias("validation_accuracies"),
        pick("val_loss").alias("validation_losses"))


def summary(epochs: DataFrame, settings: DataFrame) -> DataFrame:
    """All summary fields of each run in one aggregation."""
    rows = epochs.groupBy("run").agg(_best(), _final(), F.sum("batches").alias("_used"))
    return rows.join(settings, "run").select(
        "run", F.col("best.epoch").alias("best_epoch"),
        F.col("best.val_acc").alias("best_accuracy"), F.col("best.val_loss").alias("best_loss"),
        F.col("final.train_acc").alias("final_train_accuracy"),
        F.col("final.train_loss").alias("final_train_loss"),
        F.col("final.val_acc").alias("final_val_accuracy"),
        F.col("final.val_loss").alias("final_val_loss"),
        saturation_index(F.col("_used"), F.col("max_batches"), F.col("num_epochs"))
        .alias("dsi"),
        F.col("max_batches").alias("max_batches_per_epoch"),
        F.col("_used").cast("long").alias("total_batches_processed"))


# All settings that make two runs different. Fixed field names.
RUN_SETTINGS = ("dataset", "device", "epochs", "metric", "network", "normalize_classes", "rank",
                "schedule", "scope", "seed", "shuffled", "start_fraction")


def run_hash(config: Sequence[str] = RUN_SETTINGS) -> Column:
    """md5 of the whole configuration as JSON with sorted keys; unset fields stay as null."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(config)]),
                           {"ignoreNullFields": "false"}))


def with_hash(configs: DataFrame, config: Sequence[str] = RUN_SETTINGS) -> DataFrame:
    return configs.withColumn("hash", run_hash(config))


def run_rows(epochs: DataFrame, configs: DataFrame, folder: str = "records") -> DataFrame:
    """The flat 22-field record of each run.

    ``configs`` has one row per run: ``run, network, dataset, device, epochs, seed, shuffled,
    normalize_classes, rank, metric, scope, schedule, start_fraction, max_batches``; curriculum
    fields are NULL for baselines.
    """
    settings = configs.select("run", "max_batches", F.col("epochs").alias("num_epochs"))
    rows = summary(epochs, settings).join(with_hash(configs).drop("max_batches"), "run")
    return rows.select(
        F.col("network").alias("network_id"), F.col("dataset").alias("dataset_id"), "epochs",
        "seed", "device", F.col("final_val_accuracy").alias("final_accuracy"),
        F.col("final_val_loss").alias("final_loss"), "best_accuracy", "best_loss", "best_epoch",
        "shuffled", "normalize_classes", "rank", "metric", "scope", "schedule",
        "start_fraction", "dsi", "max_batches_per_epoch", "total_batches_processed",
        F.format_string("%s/%s_%s/%s.json", F.lit(folder), "network", "dataset", "hash")
        .alias("record_file"), "hash")


def recorded(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """Configurations that already have a run record."""
    return configs.join(runs.select("hash"), "hash", "left_semi")


def append_rows(new: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of ``new`` whose hash is not yet in ``runs``, one per hash."""
    return new.dropDuplicates(["hash"]).join(runs.select("hash"), "hash", "left_anti") \
        .select(*new.columns)


def documents(epochs: DataFrame, rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """One JSON document per run: config, results, counts and every epoch.

    ``hashes(run, hash)`` links the epoch table to the flat records; runs of equal settings are
    one record, told by the first of them.
    """
    hashes = hashes.groupBy("hash").agg(F.min("run").alias("run"))
    rows = rows.dropDuplicates(["hash"])
    nested = nest_epochs(epochs).groupBy("run").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(
            F.col("epoch").cast("string"), F.struct("train", "validation", "batches")))))
        .alias("epochs_by_id"),
        F.transform(F.array_sort(F.collect_list(F.struct("epoch", "batches"))),
                    lambda e: e["batches"]).alias("batches_per_epoch"))
    joined = nested.join(hashes, "run").join(rows, "hash")
    document = F.struct(
        F.struct(F.col("network_id").alias("network"), F.col("dataset_id").alias("dataset"),
                 "seed", "device", F.col("epochs").alias("num_epochs")).alias("config"),
        F.struct("final_accuracy", "final_loss", "best_accuracy", "best_loss", "best_epoch")
        .alias("results"), "dsi", "max_batches_per_epoch", "total_batches_processed",
        "batches_per_epoch", F.col("epochs_by_id").alias("epochs"))
    return joined.select("hash", "record_file", F.to_json(document).alias("document"))


def compare(runs: DataFrame, variant: Column, value: str = "best_accuracy",
            variants: Sequence[str] = ("baseline", "shuffled", "curriculum")) -> DataFrame:
    """Best value of each variant per network and dataset, and gains over the baseline."""
    table = (runs.withColumn("_variant", variant).groupBy("network_id", "dataset_id")
             .pivot("_variant", list(variants)).agg(F.max(value)))
    first, *others = variants
    return table.withColumns({f"{v}_gain": F.col(v) - F.col(first) for v in others})


def variant_of() -> Column:
    """baseline, shuffled or curriculum, from a run's settings."""
    return (F.when(F.col("rank").isNotNull(), "curriculum")
            .when(F.col("shuffled"), "shuffled").otherwise("baseline"))


def experiment_grid(datasets: DataFrame, choices: dict[str, Sequence],
                    done: DataFrame | None = None) -> DataFrame:
    """Every dataset with every combination of settings, minus the runs already recorded.

    Choices are short lists exploded on each dataset row; ``done`` holds the same columns.
    """
    grid = datasets
    for name, values in choices.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid if done is None else grid.join(done, grid.columns, "left_anti")
