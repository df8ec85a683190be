"""Sharding by longest-processing-time scheduling.

Groups that must stay together (here equal texts) are sorted by size; the largest goes first,
each to the least-loaded place, found through a heap. One heap over all groups of a
corpus would be one task, so the schedule has two levels: every range partition of the
size-ordered groups packs its own into bundles through a heap, then the bundles, whose number is
bounded by ``MOST_BUNDLES``, are scheduled onto the shards the same way.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.session import settle

SHARDS = 24
# Bundles that meet on the driver: 24 bytes each, so a few MB at most.
MOST_BUNDLES = 200_000
ROW_BYTES = 8


def longest_first(sizes: list[tuple[int, int]], places: int) -> dict[int, int]:
    """Place of each (size, key): the largest first, to the least-loaded place, ties to the lowest number."""
    heap = [(0, place) for place in range(places)]
    chosen = {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, place = heap[0]
        heapq.heapreplace(heap, (load + size, place))
        chosen[key] = place
    return chosen


def _bundles(groups: DataFrame, partitions: int, bundles: int) -> DataFrame:
    """Pack the groups of every range partition, largest first, into ``bundles`` bundles."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        heap = [(0, place) for place in range(bundles)]
        for frame in frames:
            places = []
            for size in frame["_total"].tolist():
                load, place = heap[0]
                heapq.heapreplace(heap, (load + size, place))
                places.append(place)
            yield frame.assign(_part=part, _bundle=places)

    order = [F.col("_total").desc(), F.col("_group")]
    ranged = groups.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return ranged.mapInPandas(pack, "_group string, _total long, _part int, _bundle int")


def _sizes(partitions: int, shards: int) -> tuple[int, int]:
    """Range partitions and bundles a partition: at most ``MOST_BUNDLES`` bundles, or one partition, meet on the driver."""
    partitions = max(1, min(partitions, MOST_BUNDLES // shards))
    return partitions, max(shards, min(64 * shards, MOST_BUNDLES // partitions))


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot`` (0.. without gaps inside a shard, by id).

    Size is the UTF-8 length of the text plus 8. Rows with equal texts form one group and share a
    shard; null and empty text are one group of size 8 a row. Repeated ids are separate rows. A group
    larger than its even share makes its shard large: groups are never divided. Ranges of sizes come from a sample,
    so another session or partition count may shard otherwise, just as evenly. An empty table
    gives an empty result. ``columns`` names what is carried along (default: all); columns of the
    names above are replaced.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    made = ["size", "text_crc32", "shard", "slot"]
    rows = docs.select(
        *common.without(docs.select(*(columns or ["*"])), made).columns,
        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.concat(F.md5(body.cast("binary")), F.octet_length(body).cast("string")).alias("_group"),
    )
    groups = rows.groupBy("_group").agg(F.sum("size").alias("_total"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    partitions, bundles = _sizes(partitions, shards)
    packed = settle(_bundles(groups, partitions, bundles)).df
    loads = packed.groupBy("_part", "_bundle").agg(F.sum("_total").alias("_total")).collect()
    chosen = longest_first([(r["_total"], (r["_part"], r["_bundle"])) for r in loads], shards)
    frame = pd.DataFrame([(p, b, s) for (p, b), s in chosen.items()], columns=["_part", "_bundle", "shard"]).astype("int32")
    places = spark.createDataFrame(frame, "_part int, _bundle int, shard int")
    of_group = packed.join(F.broadcast(places), ["_part", "_bundle"]).select("_group", "shard")
    sharded = rows.join(of_group, "_group").drop("_group")
    written, runs = common.placed_in_order(sharded, ["doc_id", "text_crc32"], "shard")
    slots = common.join_checked(written, runs, ["shard", "_part"])
    return slots.withColumn("slot", F.col("_at") - F.col("_first") + F.col("_before")).drop(
        "_part", "_at", "_first", "_n", "_before"
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard."""
    sharded.write.partitionBy("shard").parquet(path)
