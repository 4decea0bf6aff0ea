"""Longest-processing-time sharding of groups that must stay together."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, saved


def schedule(classes: list[tuple[int, int]], n_shards: int) -> list[tuple[int, int, list[int]]]:
    """LPT over classes of equal groups: [(size, first rank, ends)] from [(size, number of groups)].

    Groups are ranked by falling size; those of a class with rank below first + ends[j], and not
    below first + ends[j-1], go to shard j. Each group goes to the least-loaded shard (the lowest
    number in a tie), taken from a heap. Whole rounds that raise every shard's load alike are
    counted at once, so that the work depends on the number of sizes, not of groups.
    """
    load = [(0, j) for j in range(n_shards)]
    out, rank = [], 0
    for size, count in sorted(classes, reverse=True):
        got, left = [0] * n_shards, count
        while left:
            spread = max(load)[0] - load[0][0]
            if spread < size and left >= n_shards:  # each of the next n_shards groups goes to another shard
                rounds = left // n_shards
                load = [(at + rounds * size, j) for at, j in load]
                heapq.heapify(load)
                got = [g + rounds for g in got]
                left -= rounds * n_shards
            else:
                at, j = load[0]
                other = load[1][0] if n_shards > 1 else at
                if n_shards > 2:
                    other = min(other, load[2][0])
                times = min(left, max(1, (other - at) // max(size, 1)))
                heapq.heapreplace(load, (at + times * size, j))
                got[j] += times
                left -= times
        ends, total = [], 0
        for g in got:
            total += g
            ends.append(total)
        out.append((size, rank, ends))
        rank += count
    return out


def lpt_shards(rows: DataFrame, group: Column, size: Column, order: Column, n_shards: int = 8) -> DataFrame:
    """`rows` with `shard` and `slot` (gapless from 0 within a shard, by `order`).

    Rows of equal `group` share a shard. Group sizes are summed map-side; the driver gets one row
    for each distinct group size (at most twice the square root of all bytes), never the groups.
    Columns of `rows` must not be named __group, __size, __order, shard or slot. Null groups are
    one group, null sizes count 0, null orders come first, repeated rows are kept, an empty table
    gives an empty result.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = rows.sparkSession
    rows = saved(rows.select("*", group.alias("__group"), F.coalesce(size, F.lit(0)).cast("long").alias("__size"), order.alias("__order")), "lpt-rows")
    groups = rows.groupBy("__group").agg(F.sum("__size").alias("__total"), F.min("__order").alias("__first"))
    groups = ranked(groups, [F.desc("__total"), F.asc("__first"), F.asc("__group")], "__rank", "lpt-groups")
    classes = [(r[0], r[1]) for r in groups.groupBy("__total").count().collect()]
    plan = spark.createDataFrame(schedule(classes, n_shards), "__total long, __start long, __ends array<long>")
    place = F.size(F.filter("__ends", lambda end: end <= F.col("__rank") - F.col("__start"))).cast("int")
    homes = groups.join(plan, "__total").select(F.col("__group").alias("__home"), place.alias("shard"))
    placed = rows.join(homes, F.col("__group").eqNullSafe(F.col("__home"))).drop("__home")
    return ranked(placed, ["shard", "__order", "__group"], "slot", "lpt-slots", within="shard").drop("__group", "__size", "__order")


def text_group(text: Column) -> Column:
    """The same for equal texts only (SHA-256); null is a group of its own."""
    return F.sha2(text, 256)


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; equal texts stay together.

    Law `bytes`: shard sizes near equal. Null text counts as no bytes and shares a shard with other
    null texts; empty text is another group. Extra columns are left out.
    """
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        text_group(F.col("text")).alias("same"),
    )
    out = lpt_shards(narrow, F.col("same"), F.col("size"), F.col("doc_id"), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
