"""Shards of nearly equal bytes by Karmarkar-Karp differencing of indivisible groups."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velotide.llm.common import stage

PER_CELL = 2_000  # items that one task differences at a time
AT_ONCE = 8_192  # items of the last differencing
LARGE_SHARE = 1_024  # an item over 1/1024 of all bytes is kept whole for the last differencing


def difference(sizes: np.ndarray, parts: int) -> np.ndarray:
    """The part (0 to ``parts`` - 1) of every item. Each item starts as a partial partition with
    itself in one part. The two with the largest spread are combined, the fullest part of one with
    the emptiest of the other, until one is left. Equal spreads go by the place of the item."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    sums = {k: [0] * (parts - 1) + [int(s)] for k, s in enumerate(sizes)}
    members = {k: [None] * (parts - 1) + [(k, None, None)] for k in range(len(sizes))}  # trees of items
    heap = [(-int(s), k) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        low, high = sums.pop(a), sums.pop(b)[::-1]
        trees, others = members.pop(a), members.pop(b)[::-1]
        joined = sorted(
            (
                (x + y, p, t if o is None else o if t is None else (None, t, o))
                for p, (x, y, t, o) in enumerate(zip(low, high, trees, others, strict=True))
            ),
            key=lambda j: j[:2],
        )
        sums[a], members[a] = [j[0] for j in joined], [j[2] for j in joined]
        heapq.heappush(heap, (joined[0][0] - joined[-1][0], a))
    out = np.zeros(len(sizes), np.int64)
    for part, tree in enumerate(next(iter(members.values()))):
        waiting = [tree] if tree else []
        while waiting:
            item, left, right = waiting.pop()
            if item is None:
                waiting += (left, right)
            else:
                out[item] = part
    return out


def assign(groups: DataFrame, shards: int) -> DataFrame:
    """``id``, ``shard`` for every row of ``groups`` (``id`` binary and distinct, ``size`` long).

    Items are dealt by the hash of their id to cells of about 2,000. Each cell is differenced into
    ``shards`` bundles, which are the items of the next level, until at most 8,192 are left, and
    these are differenced into the shards. Items over 1/1024 of all bytes, of which there can be no
    more than 1,024, are not bundled but enter the last level themselves, where bundles balance
    them. No task sees more than a few thousand items, whatever the input.
    """
    total, count = groups.agg(F.sum("size"), F.count("*")).first()
    large = (total or 0) // LARGE_SHARE
    items, levels = groups.select("id", "size"), []
    kind = "id binary, bundle binary"

    while count > AT_ONCE:
        depth = len(levels)
        small = items.where(F.col("size") <= large)
        cells = -(-count // PER_CELL)

        def bundles(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("id", ignore_index=True)  # results do not depend on arrival
            part = difference(pdf["size"].to_numpy(), shards)
            cell = int(pdf["cell"].iloc[0])
            names = [b"%d:%d:%d" % (depth, cell, p) for p in part]
            return pd.DataFrame({"id": pdf["id"], "bundle": names})

        celled = small.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(cells)))
        level = stage(celled.groupBy("cell").applyInPandas(bundles, kind), "bundles")
        levels.append(level)
        sums = small.join(level, "id").groupBy(F.col("bundle").alias("id")).agg(F.sum("size").alias("size"))
        items = stage(items.where(F.col("size") > large).unionByName(sums), "items")
        left = items.count()
        if left >= count:
            raise RuntimeError("bundling did not reduce the number of items")
        count = left

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        return pd.DataFrame({"id": pdf["id"], "shard": difference(pdf["size"].to_numpy(), shards).astype(np.int32)})

    placed = items.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(last, "id binary, shard int")
    if levels:
        placed = stage(placed, "placed")
    for level in reversed(levels):
        inner = level.join(placed.withColumnRenamed("id", "bundle"), "bundle").select("id", "shard")
        placed = inner.unionByName(placed)
    return groups.select("id").join(placed, "id")


def numbered(rows: DataFrame, shard: str, order: str, name: str = "slot") -> DataFrame:
    """Add a number to each row of a shard, gapless from 0, by ``order``. Rows are range-partitioned
    and numbered within their partition; the rows of earlier partitions are added, one sum per
    partition and shard."""
    ranged = stage(
        rows.repartitionByRange(shard, order).sortWithinPartitions(shard, order).withColumn("_at", F.spark_partition_id()),
        "ranged",
    )
    counts = ranged.groupBy(shard, "_at").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_at").orderBy(order, *(c for c in rows.columns if c not in (shard, order)))
    own = ranged.withColumn("_own", F.row_number().over(inside) - 1)
    return own.join(starts, [shard, "_at"]).withColumn(name, F.col("_start") + F.col("_own")).drop("_start", "_own", "_at")


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard`` for every row.

    The law is `bytes`: sizes of shards are as near to each other as groups allow. The size of a row
    is the UTF-8 bytes of its text (null: none) and 1. Rows of equal text, null and empty alike, are one
    group and go to the same shard; a group larger than an even share makes its shard that much
    larger, and the others share the rest evenly. Texts are told apart by their md5. ``slot`` numbers the
    rows of a shard by ``doc_id``, rows without one first. ``grown_shard`` is null under this law.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("id"),
    )
    rows = stage(rows, "sizes")
    groups = stage(rows.groupBy("id").agg(F.sum("size").alias("size")), "groups")
    placed = rows.join(assign(groups, shards), "id").drop("id")
    return numbered(placed, "shard", "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def sharded_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """All columns of ``docs`` with ``shard`` added (instead of a column of that name), by the same law."""
    text = F.coalesce("row.text", F.lit("")).cast("binary")
    rows = docs.select(F.struct("*").alias("row")).select(
        "row", F.unhex(F.md5(text)).alias("id"), (F.octet_length(text).cast("long") + 1).alias("size")
    )
    groups = stage(rows.groupBy("id").agg(F.sum("size").alias("size")), "groups")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() != "shard"]
    return rows.select("row", "id").join(assign(groups, shards), "id").select(*kept, "shard")
