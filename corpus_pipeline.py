"""From documents to packed training sequences: the stages, in order, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lehrplan.llm import contamination, language, near, packing, pii
from lehrplan.llm.queries import TOKENIZER, held_out, small_batches, table
from lehrplan.sources.staging import stage

ROW = "_pipeline_row"
ORACLE_SQL = None  # learned models and hashing families; tests compare with brute force


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go; others get a missing lang."""
    small_batches(spark)
    model = language.train(docs.where(~held_out()))
    found = language.identify(docs, model, keep=docs.columns, names=("_language", "_score"))
    if model.families:
        found = found.where(F.col("_language") != language.UNKNOWN)
    else:  # no labelled document: nothing can be told apart, only empty texts go
        found = found.where(F.col("text").rlike(r"\p{L}"))
    return found.select(*[F.coalesce("lang", "_language").alias("lang") if c == "lang"
                          else F.col(f"`{c}`") for c in docs.columns])


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with a number: their id, or one of their own behind all ids for rows without,
    which are written down so that it stays the same."""
    nameless = stage(docs.where("doc_id is null").withColumn(
        ROW, F.lit(1 << 62) + F.monotonically_increasing_id()), "nameless")
    return docs.where("doc_id is not null").withColumn(
        ROW, F.col("doc_id").cast("long")).unionByName(nameless)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class stays, once; one without id if no other."""
    small_batches(spark)
    rows = numbered(docs)
    classes = near.duplicate_classes(rows.select(F.col(ROW).alias("doc_id"), "text"))
    gone = stage(classes.where("doc_id <> class_id").select(F.col("doc_id").alias(ROW)).distinct(), "gone")
    again = stage(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
                  .select(F.col("doc_id").cast("long").alias(ROW)), "again")
    kept = rows.join(gone, ROW, "left_anti")
    several = kept.join(again, ROW, "left_semi").dropDuplicates([ROW])
    return kept.join(again, ROW, "left_anti").select(docs.columns).unionByName(several.select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, with an id or without; rows that share an
    id are one document."""
    small_batches(spark)
    rows = numbered(docs)
    found = contamination.contaminated(rows.select(F.col(ROW).alias("doc_id"), "text"),
                                       table(spark, sf_dir, "benchmark"))
    gone = stage(found.where(F.size("hits") > 0).select(F.col("doc_id").alias(ROW)).distinct(), "gone")
    return rows.join(gone, ROW, "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind; n_chars follows the text."""
    small_batches(spark)
    clean = pii.redact(docs, pii.train(docs))
    return clean.select(*[F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c)
                          if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return packing.pack(packing.pieces(docs, TOKENIZER))


STAGES = [("language", identify_language), ("near-duplicates", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("personal data", redact_personal_data),
          ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return stage(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
