"""Balanced label propagation onto shards.

Documents start on shards by a hash. In every round each linked document looks at the shards of
its neighbours (the other members of its groups), counted once per group and not per pair, and
asks for the shard where most of them are. A shard admits what its quota has room for; groups
move whole unless they are large. Documents without links fill the shards up at the end, so that
row counts differ by at most one and linked documents stay where they gathered.

Everything is a DataFrame operation: votes are grouped sums combined before their shuffle, the
tables of a round are written to the shared folder, and only one row per shard reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lehrplan.operators.ordering import positions
from lehrplan.sources.staging import stage

SHARDS = 8
ROUNDS = 8


def _chance(*cols: Column | str) -> Column:
    """A number from 0 to 1 by hash."""
    return F.xxhash64(*cols).cast("double") / F.lit(2.0 ** 64) + 0.5


def _by_shard(values: Sequence, name: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), name + 1)


def propagate(links: DataFrame, start: DataFrame, quota: int, shards: int = SHARDS,
              rounds: int = ROUNDS) -> DataFrame:
    """``row, shard`` of linked rows, from ``start`` (row, shard) along ``links`` (row, grp).

    Rows of a group are neighbours. No shard gets more than about ``quota`` rows (admission is
    by hash, so the number varies by its square root; what exceeds a quota exactly is for the
    caller). Stops early when nothing moves.
    """
    state = stage(start, "labels")
    sizes = stage(links.groupBy("grp").agg(F.count(F.lit(1)).alias("grp_size")), "sizes")
    links = stage(links.join(sizes, "grp"), "links")
    for turn in range(rounds):
        held = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}
        room = [max(0, quota - held.get(s, 0)) for s in range(shards)]
        votes = stage(links.join(state, "row").groupBy("grp").agg(
            F.array(*[F.sum((F.col("shard") == s).cast("long")) for s in range(shards)])
            .alias("votes")), "votes")
        asked = links.join(votes, "grp").groupBy("row").agg(
            F.array(*[F.sum(F.col("votes")[s]) for s in range(shards)]).alias("votes"),
            F.min("grp").alias("grp"), F.max("grp_size").alias("grp_size"))
        # equal votes: the same order for all rows of a group, so that they agree
        choice = F.array_max(F.array(*[
            F.when((F.lit(room[s]) > 0) | (F.col("shard") == s),
                   F.struct(F.col("votes")[s].alias("n"),
                            F.xxhash64("grp", F.lit(s)).alias("tie"), F.lit(s).alias("to")))
            for s in range(shards)]))
        wish = stage(asked.join(state, "row").withColumn("to", choice["to"])
                     .select("row", "shard", "to", "grp", "grp_size"), "wishes")
        demand = {r["to"]: r["count"]
                  for r in wish.where("to <> shard").groupBy("to").count().collect()}
        if not demand:
            break
        admit = [min(1.0, room[s] / demand[s]) if demand.get(s) else 1.0 for s in range(shards)]
        unit = F.when(F.col("grp_size") * 100 > quota, F.col("row")).otherwise(F.lit(0))
        moved = _chance(F.col("grp"), unit, F.lit(turn)) < _by_shard(admit, F.col("to"))
        state = stage(wish.select("row", F.when(moved, F.col("to")).otherwise(F.col("shard"))
                                  .cast("int").alias("shard")), "labels")
    return state


def balance(placed: DataFrame, order: Sequence[Column], keep: Sequence[str],
            shards: int = SHARDS) -> DataFrame:
    """Make row counts differ by at most one: the last rows in ``order`` of full shards go to
    shards with room. Adds ``slot``, the place in the shard, from 0 without gaps."""
    ranked = stage(positions(placed, order, keep=keep, by=["shard"], label="shards"), "ranked")
    have = {r["shard"]: r["count"] for r in ranked.groupBy("shard").count().collect()}
    count = [have.get(s, 0) for s in range(shards)]
    total = sum(count)
    larger = sorted(range(shards), key=lambda s: (-count[s], s))[:total % shards]
    target = [total // shards + (s in larger) for s in range(shards)]
    over, free = [0], [0]
    for s in range(shards):
        over.append(over[-1] + max(0, count[s] - target[s]))
        free.append(free[-1] + max(0, target[s] - count[s]))
    full = _by_shard(target, F.col("shard"))
    spill = F.col("position") - full + _by_shard(over[:-1], F.col("shard"))
    to = F.coalesce(*[F.when(spill < free[s + 1], F.lit(s)) for s in range(shards)])
    out = ranked.withColumn("_to", F.when(F.col("position") >= full, to))
    slot = spill - _by_shard(free[:-1], F.col("_to")) + _by_shard(count, F.col("_to"))
    return out.select(*[F.col(c) for c in keep],
                      F.coalesce("_to", "shard").cast("int").alias("shard"),
                      F.when(F.col("_to").isNull(), F.col("position")).otherwise(slot)
                      .cast("long").alias("slot"))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row of ``docs`` (doc_id, text).

    Rows with equal texts are linked. ``size`` is the bytes of the text plus 1; a null text has
    no bytes, check sum 0 and no links. Repeated rows and null ids are rows like any other.
    Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.unhex(F.md5(text))).alias("grp"),
        F.monotonically_increasing_id().alias("row")), "rows")
    repeated = stage(rows.where("grp is not null").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
                     .where("n > 1").select("grp"), "groups")
    links = stage(rows.join(repeated, "grp").select("row", "grp"), "member")
    first = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    quota = rows.count() // shards
    state = propagate(links, links.select("row", first.alias("shard")), quota, shards, rounds)
    member = links.join(state, "row").select("row", F.col("shard").alias("_shard"),
                                             F.col("grp").alias("_grp"))
    placed = rows.join(member, "row", "left").select(
        "doc_id", "size", "text_crc32", "row", "_grp",
        F.coalesce("_shard", first).alias("shard"))
    order = [F.col("_grp").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    return balance(placed, order, ["doc_id", "size", "text_crc32"], shards)
