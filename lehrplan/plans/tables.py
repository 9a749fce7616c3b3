"""Score, image and telemetry tables derived from the TPC-H-like source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lehrplan.operators.ordering import positions


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scores_orders(spark: SparkSession, folder: str) -> DataFrame:
    """One sample per order; orders without lines have missing line metrics.

    Discounts and taxes are summed as whole cents, so averages do not depend on row order.
    """
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    lines = load(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("line_count"),
        F.sum("l_quantity").alias("sum_qty"),
        (cents("l_discount") / (F.count(F.lit(1)) * 100.0)).alias("avg_discount"),
        (cents("l_tax") / (F.count(F.lit(1)) * 100.0)).alias("avg_tax"))
    orders = load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("index"), F.col("o_orderpriority").alias("class"),
        F.col("o_totalprice").alias("total_price"))
    return (orders.join(lines, orders["index"] == lines["l_orderkey"], "left")
            .drop("l_orderkey"))


def scores_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """One sample per supplier, with the metrics of orders over the lines it supplied."""
    cents = lambda c: F.sum(F.round(F.col(c) * 100).cast("long"))
    lines = load(spark, folder, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).cast("double").alias("line_count"), F.sum("l_quantity").alias("sum_qty"),
        (cents("l_discount") / (F.count(F.lit(1)) * 100.0)).alias("avg_discount"),
        (cents("l_tax") / (F.count(F.lit(1)) * 100.0)).alias("avg_tax"))
    suppliers = load(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("index"), F.col("s_acctbal").alias("total_price"))
    return suppliers.join(lines, suppliers["index"] == lines["l_suppkey"], "left").drop("l_suppkey")


def scores_part(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "part").select(
        F.col("p_partkey").alias("index"), F.col("p_brand").alias("class"),
        F.col("p_size").cast("double").alias("p_size"), "p_retailprice")


def scores_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Length and (for labelled documents only) quality scores."""
    labels = load(spark, folder, "labels")
    docs = load(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("index"), F.col("lang").alias("class"),
        F.col("n_chars").cast("double").alias("n_chars"),
        F.col("quality").cast("double").alias("quality"),
        F.col("toxic").cast("double").alias("toxic"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings read as one-channel 8x8 images; the label picks the split."""
    return load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("index"), F.col("label").cast("string").alias("class"),
        F.when(F.col("label") % 5 == 0, "test").otherwise("train").alias("split"),
        F.lit(1).alias("c"), F.lit(8).alias("h"), F.lit(8).alias("w"),
        F.col("embedding").alias("data"))


def rgb_images(spark: SparkSession, folder: str) -> DataFrame:
    """An embedding, its reverse and its rotation by 21 as the planes of a 3x8x8 image in [0, 1]."""
    planes = F.concat("data", F.reverse("data"), F.slice("data", 22, 43), F.slice("data", 1, 21))
    return images(spark, folder).select(
        "index", "class", "split", F.lit(3).alias("c"), F.lit(8).alias("h"),
        F.lit(8).alias("w"),
        F.transform(planes,
                    lambda v: F.greatest(F.lit(0.0), F.least(
                        F.lit(1.0), v.cast("double") + 0.5)).cast("float")).alias("data"))


def logits(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings").select(
        F.col("vec_id").alias("index"), F.lit("run").alias("run"), F.lit(1).alias("epoch"),
        F.expr("cast(vec_id div 32 as int)").alias("batch_idx"),
        F.col("embedding").alias("logits"), F.col("label").alias("target"))


EVENT_BATCHES = 10
EVENT_EPOCHS = 30


def batch_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Signals per run (event type), epoch (day) and batch (user), from event values.

    Sums are taken in whole cents to be independent of row order.
    """
    mean = lambda scale: (F.sum(F.round(F.col("value") * 100).cast("long"))
                          / (F.count(F.lit(1)) * (100.0 * scale)))
    return (load(spark, folder, "events")
            .groupBy(F.col("event_type").alias("run"),
                     F.dayofmonth("ts").alias("epoch"),
                     (F.col("user_id") % EVENT_BATCHES).cast("int").alias("batch_idx"))
            .agg(mean(1.0).alias("mean_std"), mean(10.0).alias("mean_grad_norm"),
                 mean(100.0).alias("mean_entropy")))


def epoch_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Loss and accuracy per run and epoch, with the number of batches used."""
    cents = F.sum(F.round(F.col("value") * 100).cast("long"))
    share = lambda low: (F.count(F.when(F.col("value") > low, 1))
                         / F.count(F.lit(1)).cast("double"))
    return (load(spark, folder, "events")
            .groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"))
            .agg((cents / (F.count(F.lit(1)) * 10000.0)).alias("train_loss"),
                 share(50).alias("train_acc"),
                 (cents / (F.count(F.lit(1)) * 8000.0)).alias("val_loss"),
                 share(40).alias("val_acc"),
                 F.count_distinct(F.col("user_id") % EVENT_BATCHES).cast("int")
                 .alias("batches")))


def event_runs(spark: SparkSession, folder: str, batch_size: int = 128) -> DataFrame:
    """One run per event type; its samples are its events."""
    return (load(spark, folder, "events").groupBy(F.col("event_type").alias("run"))
            .agg(F.count(F.lit(1)).alias("samples"))
            .withColumn("total_batches",
                        F.ceil(F.col("samples") / float(batch_size)).cast("int")))


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Loss history per user: iteration = place of the event in (ts, event_id) order."""
    events = load(spark, folder, "events").select(
        F.col("user_id").alias("index"), "ts", "event_id", F.col("value").alias("loss"))
    return (positions(events, [F.col("ts").asc(), F.col("event_id").asc()],
                      keep=["loss"], by=["index"], label="history")
            .select("index", (F.col("position") + 1).cast("int").alias("iteration"), "loss"))


def layer_history(spark: SparkSession, folder: str) -> DataFrame:
    """Weight-change series per user and layer (event type)."""
    events = load(spark, folder, "events").select(
        F.col("user_id").alias("index"), F.col("event_type").alias("layer"), "ts", "event_id",
        F.col("value").alias("delta"))
    return (positions(events, [F.col("ts").asc(), F.col("event_id").asc()],
                      keep=["delta"], by=["index", "layer"], label="layer-history")
            .select("index", "layer", (F.col("position") + 1).cast("int").alias("iteration"),
                    "delta"))


def weight_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings of a label read as successive weight snapshots of four layers."""
    rows = load(spark, folder, "embeddings").select(
        F.col("label").cast("long").alias("index"),
        F.concat(F.lit("layer"), (F.col("vec_id") % 4).cast("string")).alias("layer"),
        "vec_id", F.col("embedding").alias("weights"))
    return (positions(rows, [F.col("vec_id").asc()], keep=["weights"],
                      by=["index", "layer"], label="snapshots")
            .select("index", "layer", F.col("position").cast("int").alias("iteration"),
                    "weights"))


def layer_values(spark: SparkSession, folder: str) -> DataFrame:
    """Per-element activations or gradients: run, epoch, batch, layer, value."""
    return load(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("run"), F.month("l_shipdate").alias("epoch"),
        (F.col("l_suppkey") % 10).cast("int").alias("batch_idx"),
        F.concat(F.lit("layer"), F.col("l_linenumber").cast("string")).alias("layer"),
        F.col("l_quantity").alias("value"))
