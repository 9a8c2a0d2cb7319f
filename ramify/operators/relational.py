"""Relational primitives that the domain operators are made of; each maps a DataFrame to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramify.scratch import saved


def equal_width_bin(value: Column, low: Column, high: Column, n: int) -> Column:
    """Number (from 1) of the right-closed bin of equal width; the lowest value falls in the first."""
    width = (high - low) / n
    return F.greatest(F.lit(1), F.least(F.lit(n), F.ceil((value - low) / width))).cast("int")


def average_rank(value: str, *partition: str) -> Column:
    """Rank from 1 within the partition; ties share their mean rank."""
    order = Window.partitionBy(*partition).orderBy(value)
    same = Window.partitionBy(*partition, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def only_once(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key no other row has."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("_n = 1").drop("_n")


def min_max(value: str, *partition: str) -> Column:
    """Value scaled to [0, 1] within the partition."""
    w = Window.partitionBy(*partition)
    return (F.col(value) - F.min(value).over(w)) / (F.max(value).over(w) - F.min(value).over(w))


def vote(df: DataFrame, key: str, choice: str) -> DataFrame:
    """(key, choice, votes): the most frequent choice of each key, the least on ties."""
    counts = df.groupBy(key, choice).agg(F.count("*").alias("votes"))
    best = F.max(F.struct(F.col("votes"), (-F.col(choice).cast("long")).alias("neg"), F.col(choice)))
    return counts.groupBy(key).agg(best.alias("b")).select(key, f"b.{choice}", "b.votes")


def _ranged(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` in ranges of ``order``, written once, with the range's number as _part."""
    return saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")


def numbered(df: DataFrame, order: list[str], key: list[str] | None = None) -> DataFrame:
    """``df`` with _i (place from 0 in ``order`` within ``key``) and _n (rows of the key).

    Rows are sorted in ranges; each range adds up what stands before it, so a key of any size
    takes as many tasks as it has ranges.
    """
    key = key or []
    rows = _ranged(df, *key, *order)
    sizes = rows.groupBy(*key, "_part").agg(F.count("*").alias("_m"))  # a row per range, and one more per key at most
    whole = Window.partitionBy(*key)
    before = F.coalesce(F.sum("_m").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*key, "_part", before.alias("_before"), F.sum("_m").over(whole).alias("_n"))
    local = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(*order)) - 1
    return rows.withColumn("_l", local).join(offsets, [*key, "_part"]).withColumn("_i", F.col("_before") + F.col("_l")).drop("_l", "_before", "_part")


def bh_adjusted(df: DataFrame, p: str, out: str, log: bool = False) -> DataFrame:
    """Benjamini-Hochberg over all rows; null p values get null and don't count.

    Equal p values share the rank of the last of them, so distinct ones are counted first, then
    ranked and scanned for minima in ranges, with a row per range carried over.
    """
    known = df.where(F.col(p).isNotNull())
    rows = _ranged(known.groupBy(p).agg(F.count("*").alias("_m")), p)
    part = Window.partitionBy("_part")
    sizes = rows.groupBy("_part").agg(F.sum("_m").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"), F.sum("_s").over(Window.partitionBy()).alias("_n"))  # a row per range
    ranked = rows.join(F.broadcast(offsets), "_part").withColumn("_r", F.col("_before") + F.sum("_m").over(part.orderBy(p).rowsBetween(Window.unboundedPreceding, 0)))
    q = F.col(p) + F.log(F.col("_n") / F.col("_r")) if log else F.col(p) * F.col("_n") / F.col("_r")
    ranked = ranked.withColumn("_q", q)
    least = ranked.groupBy("_part").agg(F.min("_q").alias("_least"))
    after = least.select("_part", F.min("_least").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    scanned = ranked.join(F.broadcast(after), "_part").withColumn(out, F.least(F.min("_q").over(part.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)), "_after"))
    return df.join(scanned.select(p, out), p, "left").select(*df.columns, out)


def bonferroni(df: DataFrame, p: str, out: str) -> DataFrame:
    return df.join(F.broadcast(df.agg(F.count(p).alias("_n")))).withColumn(out, F.least(F.col(p) * F.col("_n"), F.lit(1.0))).drop("_n")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def value_windows(low: float, high: float, n: int, steps: int) -> list[tuple[float, float]]:
    """n * steps overlapping windows of width (high - low) / n, those that end before ``high``."""
    size = (high - low) / n
    return [(low + i * size / steps, low + i * size / steps + size) for i in range(n * steps) if low + i * size / steps + size < high]


def count_windows(df: DataFrame, order: list[str], size: int, step: int, key: list[str] | None = None, width: int | None = None, stride: int | None = None) -> DataFrame:
    """Rows with ``window``: windows of ``size`` rows every ``step`` rows, as range(0, n - size, step).

    ``width`` rows of each are taken, and ``stride`` rows stand between their starts, if given; their number stays.
    """
    width, stride = width or size, stride or step
    rows = numbered(df, order, key)
    first = F.greatest(F.lit(0), F.ceil((F.col("_i") - (width - 1)) / stride))
    last = F.least(F.floor(F.col("_i") / stride), F.ceil((F.col("_n") - size) / step) - 1)
    spread = rows.where(last >= first).withColumn("window", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return spread.drop("_i", "_n")


def nearest(df: DataFrame, value: str, grid: DataFrame, grid_value: str, take: str, out: str) -> DataFrame:
    """For each row the ``take`` of the nearest grid value (the first on ties); a small grid is an array."""
    points = grid.agg(F.sort_array(F.collect_list(F.struct(grid_value, take))).alias("_g"))
    near = F.array_min(F.transform("_g", lambda g: F.struct(F.abs(g[grid_value] - F.col(value)).alias("d"), g[grid_value].alias("at"), g[take].alias("v"))))
    return df.crossJoin(F.broadcast(points)).withColumn(out, near["v"]).drop("_g")


def between_open(df: DataFrame, value: str, ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Range join with a small table of open intervals."""
    return df.join(F.broadcast(ranges), (F.col(value) > F.col(low)) & (F.col(value) < F.col(high)))


def uniform(seed: int, *key: Column) -> Column:
    """A draw from [0, 1) that depends on the seed and the key only, not on partitions."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 53)) / float(1 << 53)
