"""Connected components by alternating large-star and small-star steps.

Each step replaces links by links to a smaller neighbour; at the end every node links to the
smallest of its component. Links live in DataFrames throughout; each round is checkpointed to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramify.scratch import shared_dir


def _to_smallest(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the smallest of u and its neighbours. Hot nodes: the minimum is
    taken before the shuffle, and the join is one whose skewed partitions Spark splits."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _to_smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _to_smallest(down)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns), root the smallest node reachable."""
    shared_dir(links.sparkSession)
    a, b = links.columns
    now = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct().checkpoint()
    state = None
    for _ in range(max_rounds):
        now = _small_star(_large_star(now)).checkpoint()
        # Two sums that tell whether any link changed; one row reaches the driver.
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
