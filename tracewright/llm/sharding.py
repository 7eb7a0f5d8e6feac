"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring is a fixed number of equal slots. Every shard owns ``vnodes`` points; a key falls into the
slot of its hash and belongs to the next point clockwise. Shards have a capacity; what a full shard
cannot take continues clockwise to the next shard with room. Only the number of rows per slot reaches
the driver (at most 2^ring_bits numbers, whatever the input), where the overflow is planned slot by
slot; rows then find their shard by their rank within the slot.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

SHARDS, VNODES, RING_BITS = 40, 64, 16


def ring_points(shards: int, vnodes: int, ring_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all virtual nodes in clockwise order, and their shards. A shard's points do not depend on the others."""
    points = sorted((zlib.crc32(f"{s}:{v}".encode()) * 0x9E3779B1 % (1 << 32) >> (32 - ring_bits), s) for s in range(shards) for v in range(vnodes))
    return np.array([p for p, _ in points]), np.array([s for _, s in points])


def capacities(total: int, shards: int, epsilon: float) -> np.ndarray:
    """epsilon 0: loads are at most one apart. Otherwise ceil((1 + epsilon) * mean)."""
    if epsilon == 0:
        return np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    return np.full(shards, int(np.ceil((1 + epsilon) * total / shards)), np.int64)


def plan_ring(loads: dict[int, int], shards: int, vnodes: int = VNODES, ring_bits: int = RING_BITS, epsilon: float = 0.0) -> pd.DataFrame:
    """Segments (slot, first, last, shard, offset): of a slot's rows, ranks first..last go to the shard, from place offset on.

    Keys are taken in rounds. In round r every arc offers what it still holds to the r-th point
    clockwise of it; a shard takes up to its room in clockwise order of the arcs.
    """
    room = capacities(sum(loads.values()), shards, epsilon)
    at, owner = ring_points(shards, vnodes, ring_bits)
    pending: list[tuple[int, int, int, int]] = []  # point, slot, first rank, rows
    for slot in sorted(loads):
        if loads[slot]:
            pending.append((int(np.searchsorted(at, slot)) % len(at), slot, 0, loads[slot]))
    taken, out = np.zeros(shards, np.int64), []
    while pending:
        later = []
        for point, slot, first, n in pending:
            s = int(owner[point])
            k = int(min(n, room[s] - taken[s]))
            if k:
                out.append((slot, first, first + k - 1, s, int(taken[s])))
                taken[s] += k
            if k < n:
                step = (point + 1) % len(at)
                while room[owner[step]] <= taken[owner[step]]:
                    step = (step + 1) % len(at)
                later.append((step, slot, first + k, n - k))
        pending = later
    return pd.DataFrame(out, columns=["slot", "first", "last", "shard", "offset"]).astype({"shard": "int32"})


def assign_shards(df: DataFrame, key: str, shards: int = SHARDS, vnodes: int = VNODES, ring_bits: int = RING_BITS, epsilon: float = 0.0) -> DataFrame:
    """df with ``shard`` and ``place`` (gapless from 0 within the shard); columns of these names are replaced.

    Equal keys, null included, share a slot. Ranks within a slot follow the key, then all other
    columns, so the same rows give the same places on any partitioning. An empty table gives no rows.
    """
    spark, df = df.sparkSession, df.drop("shard", "place")
    slot = F.shiftrightunsigned(F.xxhash64(F.col(key)), 64 - ring_bits).cast("int")
    loads = {r["ring_slot"]: r["n"] for r in df.select(slot.alias("ring_slot")).groupBy("ring_slot").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_ring(loads, shards, vnodes, ring_bits, epsilon), "slot int, first long, last long, shard int, offset long")
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), slot.alias("ring_slot"))
    order = Window.partitionBy("ring_slot").orderBy(f"row.{key}", "row")
    ranked = row.withColumn("ring_rank", F.row_number().over(order).cast("long") - 1)
    on = (F.col("ring_slot") == F.col("slot")) & F.col("ring_rank").between(F.col("first"), F.col("last"))
    # at most 2^ring_bits segments, and one more for each time that a shard fills
    return ranked.join(F.broadcast(plan), on).select("row.*", "shard", (F.col("offset") + F.col("ring_rank") - F.col("first")).alias("place"))


def op8_ring_shards(spark, sf_dir):
    """Every document in one of 40 shards; law ``rows``: shard sizes differ by one at most.

    Null text: size 16 and the crc of nothing, 0. Repeated rows are placed one by one.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return assign_shards(rows, "doc_id").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
