"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lehrplan.llm import (ann, bpe, centroids, contamination, filters, language, near, packing, pii,
                          sharding, spans, suffixes, urls)

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

SLOP = 3  # words by which the two rarest words of a window may stand nearer or farther than in the item

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def small_batches(spark: SparkSession) -> None:
    """Texts are wide rows: send a thousand at a time to Python, unless the session says else."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, "1000")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_balanced_labels(spark, d):
    """Equal texts gather on shards whose row counts differ by at most one."""
    rows = sharding.balanced_shards(table(spark, d, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op2_adaptive_scan(spark, d):
    return ann.nearest(table(spark, d, "embeddings"))


def op3_redirect_equivalence(spark, d):
    return urls.judge(table(spark, d, "pages"), urls.rule_table(spark, RULES))


def op4_probminhash(spark, d):
    return near.duplicate_classes(table(spark, d, "documents"))


def op5_sentence_spans(spark, d):
    rows = spans.remove_repeated(table(spark, d, "documents"))
    return rows.select("doc_id", "n_sentences", "n_removed",
                       F.length("kept").cast("long").alias("kept_chars"),
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language_hierarchy(spark, d):
    docs = table(spark, d, "documents")
    model = language.train(docs.where(~held_out()))
    return language.identify(docs, model).select("doc_id", held_out().alias("held_out"),
                                                 "lang_pred", "score")


def op7_length_histogram(spark, d):
    return packing.pack(packing.pieces(table(spark, d, "documents"), TOKENIZER))


def _joined(name: str) -> Column:
    return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])),
                        ",")


def op8_semi_markov(spark, d):
    docs = table(spark, d, "documents")
    rows = pii.personal_data(docs, pii.train(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, partial(F.equal_null, F.lit(k)))).cast("long").alias(f"n_{k}")
              for k in pii.KINDS]
    return rows.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256)
                       .alias("base_sha256"), _joined("spans").alias("spans"))


def op9_suffix_levels(spark, d):
    rows = suffixes.remove_repeats(table(spark, d, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


def op10_positional_index(spark, d):
    rows = contamination.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"),
                                      slop=SLOP)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return rows.select("doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"),
                       F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
                       (F.size("hits") > 0).alias("contaminated"),
                       F.size("near").cast("long").alias("n_near"))


def op11_transition_scan(spark, d):
    """The scan is for the pattern that all files of public_tokenizers share."""
    rows = bpe.decode(bpe.encode(table(spark, d, "documents"), RANKS), RANKS)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_integer_centroids(spark, d):
    rows = centroids.cluster(table(spark, d, "embeddings"))
    components = F.concat_ws(",", F.col("centroid").cast("array<string>"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                       F.sha2(components.cast("binary"), 256).alias("centroid_sha256"))


def op13_byte_transducer(spark, d):
    return filters.audit(table(spark, d, "documents"), table(spark, d, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_balanced_labels, op2_adaptive_scan, op3_redirect_equivalence, op4_probminhash,
        op5_sentence_spans, op6_language_hierarchy, op7_length_histogram, op8_semi_markov,
        op9_suffix_levels, op10_positional_index, op11_transition_scan, op12_integer_centroids,
        op13_byte_transducer)}
