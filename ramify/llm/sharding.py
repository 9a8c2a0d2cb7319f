"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring is divided into ``cells``; each shard owns ``vnodes`` points on it. A row belongs to
the first point clockwise from the hash of its text, so equal texts start at the same point.
A shard that is full passes further rows on clockwise to the next point whose shard has room.
Which rows those are follows from their rank on the ring, so only the number of rows per cell
(a fixed number of cells) reaches the driver; the ranks themselves are computed in small
sub-cells, of which a hot cell gets as many as it needs.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ramify.scratch import saved

CELLS = 1 << 16


def ring_points(shards: int, vnodes: int, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise; a taken cell sends the next one on."""
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            c = zlib.crc32(f"shard-{shard}/{v}".encode()) % cells
            while c in taken:
                c = (c + 1) % cells
            taken[c] = shard
    return sorted(taken.items())


def capacities(n: int, shards: int, slack: float) -> list[int]:
    """Rows a shard may hold. Without slack they add up to n, so all shards end up full."""
    if slack > 0:
        return [math.ceil((1 + slack) * n / shards)] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def bounded_plan(counts: dict[int, int], shards: int, vnodes: int, slack: float = 0.0, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where the rows of each cell go."""
    points = ring_points(shards, vnodes, cells)
    room = capacities(sum(counts.values()), shards, slack)
    used = [0] * shards
    waiting: list[list[tuple[int, int, int]]] = [[] for _ in points]
    at = 0
    for cell in sorted(counts):
        while at < len(points) and points[at][0] < cell:
            at += 1
        waiting[at % len(points)].append((cell, 0, counts[cell]))
    plan = []
    while any(waiting):
        moved: list[list[tuple[int, int, int]]] = [[] for _ in points]
        for i, (_, shard) in enumerate(points):
            for cell, lo, hi in waiting[i]:
                take = min(hi - lo, room[shard] - used[shard])
                if take:
                    plan.append((cell, lo, lo + take, shard, used[shard]))
                    used[shard] += take
                if lo + take < hi:
                    moved[(i + 1) % len(points)].append((cell, lo + take, hi))
        waiting = moved
    return plan


def bounded_load_shards(df: DataFrame, key: str, tie: list[str], shards: int = 16, vnodes: int = 64, slack: float = 0.0, sub_rows: int = 200) -> DataFrame:
    """``df`` plus ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``key`` is hashed to a place on the ring (null like an empty text); ``tie`` orders rows
    that share a place. With ``slack`` 0 the row counts of any two shards differ by one at
    most; otherwise none exceeds (1 + slack) times the mean. Rows equal in ``key`` and ``tie``
    are interchangeable, repeated rows each take a slot, and an empty table gives none.
    """
    spark = df.sparkSession
    cell = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(key), F.lit(""))), 48).cast("int")
    placed = saved(df.withColumn("_cell", cell).drop(key), "ring")
    counts = {r["_cell"]: r["n"] for r in placed.groupBy("_cell").agg(F.count("*").alias("n")).collect()}  # CELLS rows at most
    plan = bounded_plan(counts, shards, vnodes, slack)
    sub_rows = max(sub_rows, sum(counts.values()) // 1_000_000)  # a million sub-cells or so at most
    subs = spark.createDataFrame([(c, -(-n // sub_rows)) for c, n in counts.items()] or [(-1, 1)], "_cell int, _subs int")
    steps = spark.createDataFrame(plan or [(-1, 0, 0, 0, 0)], "_cell int, _lo long, _hi long, shard int, _slot0 long")
    # Both tables have a row per cell and move at most; cells and moves are bounded by constants.
    fine = placed.join(F.broadcast(subs), "_cell").withColumn("_sub", F.pmod(F.xxhash64(*tie, F.lit(7)), F.col("_subs")).cast("int"))
    sizes = fine.groupBy("_cell", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_cell").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_cell", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_cell", "_sub").orderBy(*[F.col(c).asc_nulls_last() for c in tie])
    ranked = fine.withColumn("_r", F.row_number().over(local)).join(offsets, ["_cell", "_sub"]).withColumn("_rank", F.col("_offset") + F.col("_r") - 1)
    out = ranked.join(F.broadcast(steps), "_cell").where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return out.withColumn("slot", F.col("_slot0") + F.col("_rank") - F.col("_lo")).drop("_cell", "_subs", "_sub", "_r", "_offset", "_rank", "_lo", "_hi", "_slot0")
